"""Quality, language and decontamination against brute force; the pipeline on planted documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import decontaminate, language, quality

SF = "/root/testdata/sf0.001"


def plain_model(trusted, order):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    grams = {order: Counter()}
    for text in trusted:
        raw = b"\0" * (order - 1) + text.encode()
        for i in range(len(text.encode())):
            grams[order][raw[i : i + order]] += 1
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    discount = {}
    for n, counts in grams.items():
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            discount[n] = (0.5, 0.75, 0.9)
            continue
        y = n1 / (n1 + 2 * n2)
        two = 2 - 3 * y * n3 / n2
        three = 3 - 4 * y * n4 / n3 if n3 else two
        discount[n] = tuple(min(max(d, 0.05), high) for d, high in ((1 - 2 * y * n2 / n1, 1.0), (two, 2.0), (three, 3.0)))
    followers = {n: {} for n in grams}
    for n, counts in grams.items():
        for g, c in counts.items():
            followers[n].setdefault(g[:-1], []).append(c)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        lower = p(gram[1:])
        after = followers[n].get(gram[:-1])
        if after is None:
            return lower
        cut = lambda c: discount[n][min(c, 3) - 1]
        c = grams[n].get(gram, 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, after)) * lower) / sum(after)

    return p


@pytest.mark.parametrize("shard_rows", [2_000_000, 40])
def test_perplexity_equals_the_definition(spark, monkeypatch, shard_rows):
    rng = random.Random(3)
    words = ["ab", "bca", "é", "aab", "c", "ba", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["", None, "zzz zzz", "ab", "ab"]
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], "junk") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, total string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(25)] + [(1,), (999,)], "doc_id long")
    monkeypatch.setattr(quality, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(quality.scores, "__defaults__", (quality.ORDER, shard_rows))
    got = {r["doc_id"]: r for r in quality.classify(df, trusted, order=3).collect()}
    p = plain_model([t for t in texts[:25]], 3)
    assert len(got) == len(texts)
    logs = {}
    for i, text in enumerate(texts):
        raw = b"\0\0" + (text or "").encode()
        total = sum(math.log(p(raw[k : k + 3])) for k in range(len(raw) - 2))
        logs[i] = -total / (len(raw) - 2) if len(raw) > 2 else 0.0
        assert got[i]["perplexity"] == pytest.approx(math.exp(logs[i]), rel=1e-9)
        assert got[i]["n_bytes"] == len(raw) - 2
    for k, lang in enumerate(langs):
        known = sorted(math.floor(logs[i] / quality.BIN) for i in range(25) if (i % 3 == k or lang is None) and texts[i])
        limit = (known[math.ceil(len(known) * quality.QUANTILE) - 1] + 1) * quality.BIN
        for i in range(len(texts)):
            if i % 3 == k:
                n = max(1, got[i]["n_bytes"])
                assert got[i]["limit"] == pytest.approx(limit + quality.MARGIN / math.sqrt(n))
                assert got[i]["keep"] == (got[i]["n_bytes"] == 0 or logs[i] <= got[i]["limit"])


def test_quality_without_rows_or_trust(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nobody = spark.createDataFrame([], "doc_id long")
    assert quality.classify(empty, nobody).count() == 0
    some = spark.createDataFrame([(1, "abc", "en"), (1, "abc", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert [r["keep"] for r in quality.classify(some, nobody).collect()] == [True] * 3


def test_language_on_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    rows = docs.withColumn("held_out", language.held_out())
    found = language.identify(rows, model, carry=["held_out", "lang"]).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_sample_is_bounded_whatever_the_ids(spark):
    from pyspark.sql import functions as F

    rows = [(7, f"the and of with number {i}", "en") for i in range(1500)] + [(7, "the and of", "en")] * 500
    rows += [(None, f"les des une avec {chr(97 + i % 26)}{i}", "fr") for i in range(300)] + [(9, "der und nicht", "de")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = []
    model = language.fit(train, sample_rows=50)
    held = language.Model.__init__
    try:
        language.Model.__init__ = lambda self, x, langs: (seen.append((len(x.bounds) - 1, langs)), held(self, x, langs))[1]
        language.fit(train, sample_rows=50)
        language.fit(train.withColumn("doc_id", F.lit(None).cast("long")), sample_rows=50)
    finally:
        language.Model.__init__ = held
    for n, langs in seen:
        assert n == len(langs) == 101 and langs.count("en") == langs.count("fr") == 50 and langs.count("de") == 1
    asked = spark.createDataFrame([(None, "the and of with them"), (None, "les des une avec"), (7, "und der nicht")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(asked, model).collect()] == ["en", "fr", "de"]


def test_language_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "12 !? \n"), (4, "a"), (5, "é" * 10000), (6, "the and of " * 5), (6, "the and of " * 5)]
    df = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang_pred string")
    train = spark.createDataFrame([(10, "the and of with", "en"), (11, "les des une avec", "fr"), (12, "der und nicht", "de"), (13, None, "es"), (14, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    found = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df, model).collect())
    assert [f[1:] for f in found[:3]] == [("und", 0.0)] * 3
    assert found[-1] == found[-2] and found[-1][1] == "en"
    assert {f[1] for f in found[3:]} <= {"en", "fr", "de"}
    assert language.fit(train.where("false")) is None
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    one = language.fit(train.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language.identify(df.where("doc_id > 3"), one).collect()} == {"de"}


def test_held_out_is_the_remainder(spark):
    import zlib

    ids = [0, 1, 5, 77, 123456789012, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", language.held_out())
    assert {r["doc_id"]: r["h"] for r in df.collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


def random_corpus(seed=6):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    rare = [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(sentence(rng.randint(4, 15)) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    docs = []
    for i in range(80):
        parts = [sentence(rng.randint(3, 20)) for _ in range(rng.randint(0, 25))]
        if i % 3 == 0:
            leaked = rng.choice(items)[1]
            parts.insert(rng.randint(0, len(parts)), leaked.upper() if i % 2 else leaked.replace(" ", "\n* "))
        docs.append((i, " ".join(parts)))
    return docs, items


def test_bounds_lose_no_candidate(spark):
    docs, items = random_corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.units(table).orderBy("item_id", "unit").collect()
    index = decontaminate.Index(rows)
    import pyarrow as pa
    import pyarrow.compute as pc

    distinct, at, bounds = decontaminate.word_lists(pa.array([t for _, t in docs]))
    terms = pc.index_in(distinct, index.words).fill_null(-1).to_numpy(zero_copy_only=False)[at]
    _, start, end = decontaminate.passages(bounds)
    for threshold in (0.2, 0.35, 0.6):
        got = {(p, u): s for p, u, s in zip(*decontaminate.retrieve(index, terms, start, end, threshold))}
        names = index.words.to_pylist()
        want = {}
        for p in range(len(start)):
            words = {names[t] for t in terms[start[p] : end[p]] if t >= 0}
            for u, row in enumerate(rows):
                score = sum(s for w, s in zip(row["words"], row["shares"]) if w in words)
                if score >= threshold - 1e-9:
                    want[p, u] = score
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    for row in rows:
        assert sum(row["shares"]) == pytest.approx(1.0)


@pytest.mark.parametrize("shard_blocks", [1, 256])
def test_leaks_are_found_and_clean_documents_left(spark, shard_blocks):
    docs, items = random_corpus()
    odd = [(1000, None), (1001, ""), (1002, "of " * 5000), (1003, "the")]
    short = [(2000, "the of"), (2001, None), (2002, "")]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs + odd], "doc_id long, text string, score double").repartition(3)
    b = spark.createDataFrame(items + short, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b, shard_blocks=shard_blocks).collect()}
    norm = lambda t: " ".join(decontaminate._words(t))
    want = {(i, k) for i, t in docs + odd for k, x in items + short if norm(x or "") and f" {norm(x)} " in f" {norm(t or '')} "}
    assert any(k == 2000 for _, k in want) and want <= got
    assert {i for i, _ in got} == {i for i, _ in want}


def test_edited_leaks_and_empty_sides(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho sigma tau upsilon."
    edited = item.replace("delta", "DELTOID").replace("sigma", "")
    half = item.split(".")[0]
    b = spark.createDataFrame([(1, item), (2, "Other words entirely stand here for the benchmark item. And an answer to it.")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x y " * 40 + edited + " z" * 50), (2, half), (3, "unrelated words")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()] == [(1, 1)]
    assert decontaminate.leaks(d, b.where("false")).count() == 0
    assert decontaminate.leaks(d.where("false"), b).count() == 0


def test_in_order_is_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.in_order(a, b) == table[-1, -1]


def test_pipeline_stages_decide(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    clean = max(docs.where("lang = 'en' and length(text) between 1500 and 4000").collect(), key=lambda r: r["doc_id"])["text"]
    planted = [
        (900001, clean + "\n" + items[3]["text"] + "\n", "en", "s", 1),
        (900002, clean.replace(" the ", " the the ", 1) + "\nMail me at joe@example.org now.", "en", "s", 1),
        (900003, "#@!%^ 0x" * 400, "en", "s", 1),
        (900004, None, None, None, None),
        (900005, "", "en", "s", 0),
    ]
    frame = docs.union(spark.createDataFrame(planted, docs.schema))
    seen = {}
    for name, stage in pipeline.STAGES:
        frame = stage(spark, frame, SF)
        rows = frame.collect()
        frame = spark.createDataFrame(rows, frame.schema)
        seen[name] = {r["doc_id"]: r for r in rows}
        if name != "packing":
            assert frame.columns == docs.columns and len(rows) == len(seen[name])
    names = [name for name, _ in pipeline.STAGES]
    assert 900003 not in seen[names[0]] and {900001, 900002, 900004, 900005} <= set(seen[names[0]])
    assert not {900005} & set(seen[names[1]])  # the copy of the other text without words
    assert 900001 not in seen[names[2]]
    assert all("joe@example.org" not in (r["text"] or "") for r in seen[names[3]].values())
    assert set(seen[names[3]]) == set(seen[names[2]]) == set(seen[names[4]])
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
