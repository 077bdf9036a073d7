"""Work that must grow with the rows, not with the rows over a small limit."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom import ordering
from eventloom.operators import pair_index
from eventloom.operators.bpe import TextBpe, _as_bytes, byte_level_runs, byte_level_words, in_symbols, spelled_in_bytes
from eventloom.operators.pieces import learn
from eventloom.ordering import order_groups
from tests.test_byte_pairs import brute_force


def test_small_chunks_are_cut_within_a_bounded_number_of_ranges(spark, monkeypatch):
    written = []
    kept = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, name: (written.append(name), kept(df, name))[1])
    rows = [(i % 3, i // 3, 0) for i in range(600)] + [(0, 50, 1)] * 3 + [(9, 0, 0), (None, 0, 0)]
    df = spark.createDataFrame(rows, "subject_id bigint, at bigint, seq bigint")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        cut = order_groups(df, ["subject_id"], ["at", "seq"], limit=10)
        pieces = cut.df.where("chunk > 0").select("subject_id", "at", "seq", "chunk").collect()
        whole = {(r.subject_id, r.chunk) for r in cut.df.where("chunk = 0").collect()}
        ranges = cut.df.inputFiles()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    assert "large-group-rows" in written
    assert len([f for f in ranges if "large-group-rows" in f]) <= 4
    assert whole == {(9, 0), (None, 0)}
    assert sorted((r.subject_id, r.at, r.seq) for r in pieces) == sorted(r for r in rows if r[0] in (0, 1, 2))
    sizes, ends = {}, {}
    for r in sorted(pieces, key=lambda r: (r.subject_id, r.chunk)):
        sizes[r.subject_id, r.chunk] = sizes.get((r.subject_id, r.chunk), 0) + 1
        ends.setdefault((r.subject_id, r.chunk), []).append((r.at, r.seq))
    assert max(sizes.values()) <= 12  # ties stay together
    for (subject, chunk), held in ends.items():
        later = [k for s, c in ends for k in ends[s, c] if s == subject and c > chunk]
        assert not later or max(held) < min(later)


@pytest.mark.parametrize("seed", range(30, 36))
@pytest.mark.parametrize("share", [0, 10**6])
def test_sweeps_learn_the_same(spark, monkeypatch, seed, share):
    """Several merges from one pass over all words, and (share 0) the index from the first merge on."""
    rng = random.Random(seed)
    monkeypatch.setattr(pair_index, "BLOCK_WORDS", rng.choice([1, 4, 15]))
    monkeypatch.setattr(pair_index, "WINDOW", rng.choice([2, 6, 1000]))
    monkeypatch.setattr(pair_index, "SWEEP_SHARE", share)
    monkeypatch.setattr(pair_index, "SWEEP_MERGES", rng.choice([2, 24]))
    monkeypatch.setattr(pair_index, "SWEEPS_KEPT", rng.choice([2, 96]))
    words = Counter()
    for _ in range(50):
        words["".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))] += rng.randint(1, 4)
    once, reuse = rng.random() < 0.5, rng.random() < 0.5
    df = spark.createDataFrame(list(words.items()), "word string, freq bigint").repartition(3)
    seen = []
    made = pair_index.PairIndex.__init__
    monkeypatch.setattr(pair_index.PairIndex, "__init__", lambda self, *a: (seen.append(self), made(self, *a))[1])
    model = learn(df.select(in_symbols(F.col("word"), list("abc"), 1).alias("word"), "freq"), list("abc"), ["<a>"], 15, once, 1, reuse)
    assert (model.ids, model.merges) == brute_force(words, list("abc"), ["<a>"], 15, once, 1, reuse)
    (index,) = seen
    kinds = {p.kind for p in index.progress}
    assert kinds == {"sweep"} if share else "sweep" not in kinds


def test_one_pattern_splits_as_two_and_bytes_come_back(spark):
    pieces = ["a", "Z", "é", "日本", "𝟜", "٣", "½", "7", "12", " ", "  ", "\t", "\n", " ", " ", "'s", "'ll", "'", "-", "!?", "😀", "\x00", "_", "́"]
    rng = random.Random(4)
    texts = ["", " ", "5", " 5", "  5 ", "a  5", "it's 3's"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = df.select(byte_level_words(F.col("text")).alias("two"), F.transform(byte_level_runs(F.col("text")), _as_bytes).alias("one")).collect()
    assert all(r.one == r.two for r in got)
    assert all([spelled_in_bytes(w) for w in r.runs] == r.words for r in df.where("id >= 0").select(byte_level_runs(F.col("text")).alias("runs"), byte_level_words(F.col("text")).alias("words")).collect())
    tokenizer = TextBpe(200, 2).train_texts(F.col("text"), df)
    encoded = tokenizer.encode_texts(df, "text")
    encode = tokenizer.encoder()()
    for r in encoded.withColumn("words", byte_level_words(F.col("text"))).collect():
        assert r.tokens == (None if r.text is None else [i for w in r.words for i in encode(w)])
    back = {r.id: r.text for r in tokenizer.decode(encoded.select("id", "tokens").where("id >= 0")).collect()}
    assert back == {i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("once", [False, True])
def test_differences_at_one_place_equal_a_recount(once):
    rng = random.Random(7)
    for _ in range(3000):
        old = "".join(rng.choice("abc") for _ in range(rng.randint(2, 7)))
        at = rng.randrange(len(old) - 1)
        pair = old[at : at + 2]
        new = old.replace(pair, "X")
        more, came = pair_index.changes(old, new, once)
        weights, words = Counter(), Counter()
        for p, times, n in pair_index.differences(old, new, pair, "X", once):
            weights[p] += times
            words[p] += n
        assert {p: n for p, n in weights.items() if n} == {p: n for p, n in more.items() if n}
        assert {p: n for p, n in words.items() if n} == {p: n for p, n in came.items() if n}


def test_a_run_computes_its_events_once(spark, make_events):
    """However many operators insert rows and filter, with old and odd times, and a column without a type."""
    from eventloom.plans.timelines import TimelineRun

    made = spark.sparkContext.accumulator(0)

    def counted(code):
        made.add(1)
        return code

    rows = [(s, at, code, value, None) for s in range(5) for at, code, value in (
        ("0001-01-01 00:00:00.000001", "MEDS_BIRTH", None), ("1930-01-01", "MEDS_BIRTH", None), ("2024-01-01", "LAB//1", 1.25),
        ("2024-01-02", None, 2.0), ("2024-01-03", "BMI", 0.1 * s), (None, "LAB//2", float("nan")),
    )]
    events = make_events(rows).withColumns({"split": F.lit("train"), "note": F.lit(None)})
    config = {
        "preprocessing": [
            {"type": "filter", "matching_type": "contains", "matching_value": "LAB//3"},
            {
                "type": "demographic_aggregation",
                "measurements": [{"token_pattern": "BMI", "value_column": "numeric_value", "aggregation": "median", "remove_original_tokens": True}],
            },
            {"type": "top_k_filter", "matching_type": "starts_with", "matching_value": "LAB//", "k": 2},
            {"type": "raw_age", "keep_meds_birth": False},
            {"type": "round_numeric", "matching_type": "starts_with", "matching_value": "LAB//", "value_column": "numeric_value", "decimals": 1},
        ],
        "postprocessing": [{"type": "demographic_sort_order", "token_patterns": ["AGE"]}],
        "tokenization": {"tokenizer": "word_level", "vocab_size": 50, "insert_event_tokens": False, "insert_numeric_tokens": False, "insert_text_tokens": False},
    }

    def texts(source):
        run = TimelineRun.from_config(config)
        return sorted((r.subject_id, r.text) for r in run.tokenizer.decode(run.run(source)).collect())

    seen = texts(events.withColumn("code", F.udf(counted)("code")))
    assert made.value == len(rows)
    run = TimelineRun.from_config(config)
    rows = run.fit(events).tokens(events)
    unwritten = run.train(rows).tokenizer.decode(run.encode(rows))
    assert seen == sorted((r.subject_id, r.text) for r in unwritten.collect())
    assert seen[1] == (1, "<start> AGE 2023.0 LAB//2 nan DEMOGRAPHIC 0.1 LAB//1 1.2 <end>")
