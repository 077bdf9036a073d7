"""Leaks whose answer is short, edited or cut; items that share an id."""

from eventloom.llm import decontaminate

QUESTION = " ".join(f"alpha{i} beta{i}" for i in range(14)).capitalize() + "."
CLEAN = "Other words entirely stand here for the benchmark item and more of them. And an answer to it that is not short at all."


def leaked(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}


def test_items_that_share_an_id_are_each_found(spark):
    other = "".join(reversed(QUESTION.rstrip("."))) + "."
    items = [(None, f"{QUESTION} Er und sie und es und wir und ihr."), (None, f"{other} Omega psi chi phi upsilon tau sigma rho pi."), (None, CLEAN)]
    docs = [(1, items[0][1]), (2, items[1][1]), (3, items[2][1]), (4, "nothing of it")]
    assert leaked(spark, docs, items) == {(1, None), (2, None), (3, None)}


def test_edited_short_answers_are_found(spark):
    items = [(1, f"{QUESTION} Er."), (2, f"{QUESTION.replace('alpha', 'gamma').replace('beta', 'delta')} Omega psi chi phi."), (3, CLEAN)]
    two = items[1][1]
    docs = [(1, items[0][1].replace("Er.", "Sie.")), (2, QUESTION), (3, two.replace("psi", "rho")), (4, two.replace(" phi", "")), (5, two)]
    docs += [(6, "x y " * 40 + items[0][1].replace("alpha3", "") + " z" * 50), (7, CLEAN.split(".")[0]), (8, "nothing of it here")]
    assert leaked(spark, docs, items) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 1)}


def test_short_items_are_looked_up_word_after_word(spark):
    items = [(1, "Zeta eta."), (2, "Pi."), (3, "rho SIGMA tau, upsilon"), (4, "..."), (5, "one two three four. Five six"), (6, None)]
    docs = [(10, "a b zeta, ETA c"), (11, "zeta b eta"), (12, "x pi y"), (13, "spin"), (14, "so rho sigma tau upsilon."), (15, "rho sigma tau and upsilon")]
    docs += [(16, "one two three four five seven"), (17, "one two six"), (18, "w " * 5000 + "zeta eta " + "w " * 5000), (19, None), (20, "")]
    assert leaked(spark, docs, items) == {(10, 1), (12, 2), (14, 3), (16, 5), (18, 1)}


def test_the_rule_against_its_definition():
    import random
    from itertools import combinations

    def plain(question, answer, words):
        item, n = question + answer, len(question + answer)
        longest = lambda part: max(k for k in range(len(part) + 1) if any(subsequence(c, words) for c in combinations(part, k)))
        missing = [len(part) - longest(part) for part in (question, answer)]
        if 5 * sum(missing) > n or any(m > 2 and 5 * m > len(p) for m, p in zip(missing, (question, answer))):
            return False
        grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        broken = len(grams(item) - grams(words))
        return any(words[i : i + n] == item for i in range(len(words))) if n < 5 else broken <= (n - 2) / 2 and broken <= 3 * (n // 5)

    def subsequence(wanted, words):
        rest = iter(words)
        return all(w in rest for w in wanted)

    rng, seen = random.Random(3), set()
    for _ in range(1500):
        item = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 14))]
        cut = rng.randint(0, len(item))
        words = [w for w in item if rng.random() > 0.1]
        words = [rng.choice("xyz")] * rng.randint(0, 2) + [w if rng.random() > 0.05 else "x" for w in words]
        got = decontaminate.stands(item[:cut], item[cut:], words, 0.8) is not None
        assert got == plain(item[:cut], item[cut:], words), (item, cut, words)
        seen.add(got)
    assert seen == {True, False}
