"""Personal data and licenses against plain Python over the stated base patterns."""

import hashlib
import random
import re

import pytest

from eventloom.llm import licenses, pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx in BASE.items() for m in rx.finditer(text or "") if confirmed(k, m.group())]


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(rng.choice([15, 16, 17, 18])))
    return next(body + d for d in "0123456789" if luhn(body + d))


def adversarial(seed, n):
    rng = random.Random(seed)
    alphabet = "ab.@-_+ 0123 ().é😀,\n"
    made = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choice([
                lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))),
                lambda: ".".join(str(rng.choice([0, 7, 99, 255, 256, 1000])) for _ in range(rng.randint(2, 6))),
                lambda: rng.choice(["", " ", "-"]).join(re.findall(".{1,4}", card(rng))),
                lambda: "+1 (555) 123-4567",
                lambda: "x.y+z@mail-1.example..com_q@r.s",
            ])())
        made.append(rng.choice(["", " ", "x"]).join(parts))
    return made


def test_base_spans_equal_plain_patterns(spark):
    texts = adversarial(3, 400) + ["", None, "1 " * 20000, "9" * 20000, "a" * 50000 + "@" + "b.c" * 2000, "+" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.digest(pii.detect(df)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text)
        got = [s for s in rows[i]["spans"].split(",") if s and not s.startswith("iban")]
        assert got == want, text
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]


def test_account_numbers_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 today", "DE89 3704 0044 0532 0130 01", "GB82WEST12345698765432", "mail a@b.co", "a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in pii.digest(pii.detect(df)).orderBy("doc_id").collect()]
    assert [r["n_iban"] for r in rows] == [1, 0, 1, 0, 0]
    assert rows[3]["top_score"] > rows[4]["top_score"]


def test_redaction_covers_overlaps_and_keeps_the_rest(spark):
    texts = ["é call +1 (555) 123-4567 or a@b.co.", "nothing", None, "", "a@b.co" * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    rows = [r["text"] for r in pii.redact(pii.detect(df)).orderBy("doc_id").collect()]
    assert rows[:4] == ["é call [PHONE] or [EMAIL].", "nothing", None, ""]
    assert rows[4] == "[EMAIL]@[EMAIL]"  # what the base pattern leaves between two matches


def test_many_spans_of_one_text_cost_linear_time(spark):
    """20,000 addresses, and as many license statements, in one text: minutes when every span copies those before."""
    import time

    n = 20_000
    mails = " ".join(f"u{i}@host{i % 7}.org" for i in range(n))
    grants = "under the mit license " * n
    df = spark.createDataFrame([(1, mails, 0), (2, grants, 1)], "doc_id long, text string, score int")
    start = time.time()
    row = pii.digest(pii.detect(df.where("doc_id = 1"))).first()
    assert row["n_email"] == n and row["spans"].startswith("email:0:12,email:13:25")
    assert row["base_sha256"] == hashlib.sha256(",".join(base_spans(mails)).encode()).hexdigest()
    clean = pii.redact(pii.detect(df.where("doc_id = 1"))).first()["text"]
    assert clean == " ".join(["[EMAIL]"] * n)
    found = licenses.digest(licenses.detect(df.where("doc_id = 2"))).first()
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (4 * n, n, 0, 4 * (n - 1))
    assert time.time() - start < 60


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17, 1000])
def test_running_totals_and_pieces(spark, n):
    from pyspark.sql import functions as F

    from eventloom.llm import spans

    rng = random.Random(n)
    values = [rng.randint(0, 50) for _ in range(n)]
    text = "".join(rng.choice("aé日😀\n ") for _ in range(n * 2))
    df = spark.createDataFrame([(values, text)], "v array<int>, t string")
    sums, most = df.select(spans.running_sums(F.col("v")), spans.running(F.col("v"), lambda a, b: F.greatest(a, b))).first()
    assert sums == [sum(values[: i + 1]) for i in range(n)] and most == [max(values[: i + 1]) for i in range(n)]
    places = [(a, b) for a, b in ((0, len(text)), (5, 5), (511, 513), (512, 1024), (len(text) // 2, len(text))) if a <= b <= len(text)]
    got = df.select(*[spans.piece(spans.blocks(F.col("t")), F.lit(a), F.lit(b)) for a, b in places]).first()
    assert list(got) == [text[a:b] for a, b in places]


def test_scans_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.detect(empty)).count() == 0
    assert licenses.digest(licenses.detect(empty)).count() == 0


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def places(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for label, phrase in PHRASES.items():
        wanted = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    return len(words), found


def test_base_phrases_equal_a_word_search(spark):
    rng = random.Random(5)
    vocabulary = "under the mit license apache version 2 cc by nc CC BY Under LICENSE é lİcense ß x 2.0 mit-license".split()
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "-", ",\n", " ", "\x00"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [p for p in PHRASES.values()] * 5 + [None, "", "under the mit license " * 3000, "K ApacheK license version 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.digest(licenses.detect(df)).collect()}
    for i, text in enumerate(texts):
        n, found = places(text)
        row = rows[i]
        starts = [s for s, _ in found]
        assert (row["n_words"], row["n_base"]) == (n, len(found)), text
        assert (row["first_word"], row["last_word"]) == ((min(starts), max(starts)) if found else (None, None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the GNU General Public License, version 3 or any later version", "gpl-3.0-or-later"),
        ("GNU General Public License v2", "gpl-2.0"),
        ("GNU Lesser General Public License", "lgpl"),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
        ("BSD 3-Clause License. All rights reserved.", "all-rights-reserved,bsd-3-clause"),
        ("licensed to drive, mit dem Auto", ""),
    ],
)
def test_longer_and_better_rules_win(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.digest(licenses.detect(df)).first()["labels"] == labels
