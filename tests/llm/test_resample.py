"""Importance resampling against a definition over plain Python words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from eventloom.llm import resample

ODD = [None, "", "  ", "...", "A", "a b", "É é日 x\ny", "-lead trail-", "Same same SAME", "a1 2b", "x" * 5000, "w " * 3000]


def lists_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, longest):
    words = lists_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def expected(docs, target, longest=1, buckets=resample.BUCKETS, least=20, percent=10):
    s = Counter(bucket(g, buckets) for _, text in docs for g in grams(text, longest))
    t = Counter(bucket(g, buckets) for text in target for g in grams(text, longest))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for doc_id, text in docs:
        found = grams(text, longest)
        weight = sum(gain(bucket(g, buckets)) for g in found) // max(1, len(found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(lists_of(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, row in enumerate(able[: len(able) * percent // 100], 1):
        row[4] = place
    return sorted(map(tuple, rows), key=str)


def random_docs(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "déjà", "x1", "of", "the", "日本"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def frames(spark, docs, target):
    rows = [(text, doc_id, "other", 1) for doc_id, text in docs]
    return spark.createDataFrame(rows, "text string, doc_id long, rank string, part int"), spark.createDataFrame([(t,) for t in target], "text string")


def got(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_are_all_runs_with_repeats(longest):
    texts = ODD + [text for _, text in random_docs(50)]
    found, n_words = resample.features(pa.array([t or "" for t in texts]), longest, 997)
    for i, text in enumerate(texts):
        mine = Counter(int(bucket_of[g]) for bucket_of, numbers, edges in found for g in numbers[edges[i] : edges[i + 1]])
        assert mine == Counter(bucket(g, 997) for g in grams(text, longest))
        assert n_words[i] == len(lists_of(text))


def test_result_equals_the_definition(spark):
    docs = random_docs(400) + [(1000 + i, text) for i, text in enumerate(ODD)]
    target = ["gamma déjà of", None, "the the gamma", ""]
    assert got(resample.resample(*frames(spark, docs, target))) == expected(docs, target)


def test_longer_runs_and_fewer_buckets(spark):
    docs, target = random_docs(120), ["of the alpha beta", "x1 日本 x1"]
    df, wanted = frames(spark, docs, target)
    weighed = resample.weigh(df, resample.fit(df, wanted, 3, 50))
    assert got(resample.draw(weighed, least_words=5, percent=33)) == expected(docs, target, 3, 50, 5, 33)


def test_repeated_rows_and_null_ids_are_ranked_each(spark):
    docs = [(None, "alpha " * 25)] * 40 + [(7, "beta " * 25)] * 40 + [(8, "gamma " * 30)] * 20
    rows = got(resample.resample(*frames(spark, docs, ["alpha"])))
    assert len(rows) == 100
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 11))
    assert rows == expected(docs, ["alpha"])


def test_empty_tables(spark):
    empty, wanted = frames(spark, [], ["alpha"])
    assert got(resample.resample(empty, wanted)) == []
    docs = random_docs(30)
    df, nothing = frames(spark, docs, [])
    assert got(resample.resample(df, nothing)) == expected(docs, [])
