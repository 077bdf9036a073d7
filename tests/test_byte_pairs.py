"""Byte-pair learning against one-merge-at-a-time brute force and a public library."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.operators import pair_index
from eventloom.operators.bpe import BytePairTokens, TextBpe, byte_level_words, in_symbols
from eventloom.operators.pieces import event_encoder, learn, split_word, text_encoder


def brute_force(words, alphabet, specials, vocab_size, once_per_word, min_weight, reuse_ids):
    symbols = [*specials, *alphabet]
    ids = {s: i for i, s in enumerate(symbols)}
    next_id, merges = len(ids), []
    split = {w: list(w) for w in words}
    while next_id < vocab_size:
        weights = Counter()
        for word, freq in words.items():
            pairs = list(zip(split[word], split[word][1:]))
            for pair in set(pairs) if once_per_word else pairs:
                weights[pair] += freq
        weights = {p: w for p, w in weights.items() if w >= min_weight}
        if not weights:
            break
        best = min(weights, key=lambda p: (-weights[p], symbols.index(p[0]), symbols.index(p[1])))
        text = "".join(best)
        merges.append((*best, text))
        if text not in symbols:
            symbols.append(text)
        if text not in ids or not reuse_ids:
            ids[text] = next_id
            next_id += 1
        for word, pieces in split.items():
            split[word] = split_word(word, {best: 0}, pieces)
    return ids, merges


@pytest.mark.parametrize("seed", range(6))
def test_learning_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abcde"[: rng.randint(2, 5)]
    words = Counter()
    for _ in range(rng.randint(5, 60)):
        words["".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))] += rng.randint(1, 6)
    once, reuse, floor = rng.random() < 0.5, rng.random() < 0.5, rng.choice([1, 2, 4])
    alphabet = sorted({c for w in words for c in w})
    specials = ["<a>", "<b>"]
    df = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    prepared = df.select(in_symbols(F.col("word"), alphabet, len(specials)).alias("word"), "freq")
    size = len(alphabet) + 2 + rng.randint(3, 14)
    model = learn(prepared, alphabet, specials, size, once, floor, reuse)
    ids, merges = brute_force(words, alphabet, specials, size, once, floor, reuse)
    assert model.merges == merges
    assert model.ids == ids


@pytest.mark.parametrize("seed", range(10, 18))
def test_small_blocks_and_windows_learn_the_same(spark, monkeypatch, seed):
    """Rounds on the executors, blocks of a few words, and counts beyond the window."""
    rng = random.Random(seed)
    monkeypatch.setattr(pair_index, "BLOCK_WORDS", rng.choice([1, 4, 15]))
    monkeypatch.setattr(pair_index, "WINDOW", rng.choice([2, 6, 1000]))
    monkeypatch.setattr(pair_index, "NAMED_PAIRS", rng.choice([1, 64]))
    letters = "abcd"[: rng.randint(2, 4)]
    words = Counter()
    for _ in range(40):
        words["".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))] += rng.randint(1, 4)
    once, reuse, floor = rng.random() < 0.5, rng.random() < 0.5, rng.choice([1, 2])
    alphabet = sorted({c for w in words for c in w})
    df = spark.createDataFrame(list(words.items()), "word string, freq bigint").repartition(3)
    prepared = df.select(in_symbols(F.col("word"), alphabet, 1).alias("word"), "freq")
    size = len(alphabet) + 1 + 10
    model = learn(prepared, alphabet, ["<a>"], size, once, floor, reuse)
    assert (model.ids, model.merges) == brute_force(words, alphabet, ["<a>"], size, once, floor, reuse)


def test_a_merge_reads_the_words_that_hold_its_pair(spark, monkeypatch):
    """Of many words few hold the pairs merged later: the index reads about those, not all."""
    rng = random.Random(1)
    monkeypatch.setattr(pair_index, "BLOCK_WORDS", 60)
    words = {"".join(rng.choice("abcdefghij") for _ in range(7)): 1 for _ in range(3000)}
    words |= {f"x{i % 10}y{i // 10 % 10}z": 5000 - 100 * i for i in range(40)}
    alphabet = sorted({c for w in words for c in w})
    seen = []
    made = pair_index.PairIndex.__init__
    monkeypatch.setattr(pair_index.PairIndex, "__init__", lambda self, *a: (seen.append(self), made(self, *a))[1])
    df = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    learn(df.select(in_symbols(F.col("word"), alphabet, 0).alias("word"), "freq"), alphabet, [], len(alphabet) + 20, False, 1, True)
    (index,) = seen
    assert sum(p.merges for p in index.progress) == 20
    assert sum(p.changed for p in index.progress) > 0
    assert sum(p.read for p in index.progress) <= 4 * sum(p.changed for p in index.progress) < 3000


def test_words_are_brought_up_to_date_merge_by_merge():
    steps = pair_index.Steps()
    for pair, product in [("ab", "X"), ("Xc", "Y"), ("dd", "X"), ("Xc", "Z")]:
        steps.add(pair, product)
    assert steps.advance("abc", 0) == "Y"
    assert steps.advance("ddc", 0) == "Z"  # the product of a later merge meets the later merge only
    assert steps.advance("Xc", 3) == "Z" and steps.advance("ab", 1) == "ab"
    assert steps.advance("ddd", 0) == "Xd"


def test_no_words_learn_nothing(spark):
    empty = spark.createDataFrame([], "word string, freq bigint")
    assert learn(empty, [], ["<a>"], 10, False).merges == []


def test_event_words_round_trip(spark):
    counts = [("LAB//5//mg", 9), ("LAB//6//mg", 7), ("Q1", 20), ("Q2", 15), ("aaaa", 3), ("é€", 2)]
    df = spark.createDataFrame(counts, "token string, count bigint")
    model = BytePairTokens(40).train_words(df).model
    names = {i: s for s, i in model.ids.items()}
    encode = event_encoder(model, "</w>", {"<start>": 1})
    for word, _ in counts:
        assert "".join(names[i] for i in encode(word)) == word + "</w>"
    assert encode("<start>") == [1]
    assert 0 in encode("z")


TEXTS = [
    "age 45.2; start drug1; Glucose 145.2 mg/dL; 3 days; glucose 99.1",
    "don't stop: l'âge été, 12  months\n\nlater   we're here ",
    "日本語 text, naïve café; 7 weeks; HbA1c 6.5%",
    "glucose glucose glucose mg/dL mg/dL 2024",
] * 3


def library_tokenizer(size):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, pre_tokenizers, trainers

    core = tokenizers.Tokenizer(models.BPE(unk_token="<unk>"))
    core.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)]
    )
    trainer = trainers.BpeTrainer(
        vocab_size=size, min_frequency=2, special_tokens=["<unk>", "<bos>", "<eos>"], show_progress=False
    )
    core.train_from_iterator(TEXTS, trainer=trainer)
    return core


def test_text_vocabulary_equals_library(spark):
    core = library_tokenizer(110)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    tokenizer = TextBpe(110, min_frequency=2).train_texts(F.col("text"), df)
    assert tokenizer.model.ids == core.get_vocab()
    encoded = {r.text: r.tokens for r in tokenizer.encode_texts(df, "text").collect()}
    for text in TEXTS:
        assert encoded[text] == core.encode(text, add_special_tokens=False).ids


def test_words_of_text_equal_library(spark):
    core = library_tokenizer(90)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {r.text: r.words for r in df.select("text", byte_level_words(F.col("text")).alias("words")).collect()}
    for text in TEXTS:
        assert got[text] == [w for w, _ in core.pre_tokenizer.pre_tokenize_str(text)]


def test_smaller_vocabulary_is_a_prefix(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    large = TextBpe(110, 2).train_texts(F.col("text"), df)
    small = TextBpe(85, 2).train_texts(F.col("text"), df)
    assert large.cut(85).model.ids == small.model.ids
    assert large.cut(85).model.merges == small.model.merges
    assert text_encoder(small.model, "<unk>")("glucose") == text_encoder(large.cut(85).model, "<unk>")("glucose")


def test_whitespace_tokenizer_keeps_special_tokens(spark, make_events):
    from eventloom.operators.bpe import WhitespaceBpe
    from eventloom.operators.sequence import build_sequence
    from eventloom.operators.tokens import Markers, token_rows

    rows = token_rows(
        build_sequence(make_events([(1, "2020-01-01", "LAB//1", 5.0, None), (1, "2020-01-02", "LAB//1", 6.0, None)])),
        Markers(True, False, False),
    )
    tokenizer = WhitespaceBpe(60, Markers(True, False, False)).train(rows)
    ids = tokenizer.model.ids
    line = tokenizer.encode(rows).first()
    assert line.tokens[0] == ids["<start>"] and line.tokens[-1] == ids["<end>"]
    assert line.tokens.count(ids["<event>"]) == 2 and line.tokens.count(ids["</event>"]) == 2
    assert len(line.tokens) == len(line.timestamps)
