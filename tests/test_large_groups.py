"""Groups above the limit are cut into chunks; results must not change."""

from pyspark.sql import functions as F

from catalog.sequences import standard_tokens
from catalog.texts import phrases
from eventloom.functions import quantiles
from eventloom.functions.quantiles import exact_quantiles
from eventloom.operators.bpe import BytePairTokens
from eventloom.operators.phrases import patient_text, word_timeline
from eventloom.operators.sequence import DemographicSortOrder, NaturalLanguageTranslation, TimeIntervals, build_sequence
from eventloom.operators.static import LoadStaticData
from eventloom.operators.tokens import Markers, string_sequences, token_rows
from eventloom.operators.word_vocab import WordLevel
from eventloom.ordering import LIMIT_KEY, running_total
from eventloom.reports.cohort import sequence_metrics
from eventloom.reports.subjects import subject_timeline
from eventloom.session import materialize


def merged(df, *arrays):
    """Subjects with the chunks of each put together again."""
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r.subject_id, r.chunk)):
        entry = out.setdefault(row.subject_id, [[] for _ in arrays])
        for target, name in zip(entry, arrays):
            target.extend(row[name])
    return out


def both_ways(spark, make, limit="20"):
    plain = make()
    spark.conf.set(LIMIT_KEY, limit)
    try:
        return plain, make()
    finally:
        spark.conf.unset(LIMIT_KEY)


def test_strings_and_gaps(spark, fixtures):
    def make():
        rows = build_sequence(fixtures.events())
        rows = TimeIntervals(None, True, True, "MIMIC").apply(rows)
        df = string_sequences(token_rows(rows, Markers()))
        chunks = df.agg(F.max("chunk")).first()[0]
        return merged(df, "strings", "timestamps"), chunks

    (plain, none), (cut, chunks) = both_ways(spark, make)
    assert none == chunks == 0  # one row per subject at every size
    assert plain == cut


def test_sorted_untimed_rows(spark, fixtures):
    columns = [
        {"column_name": c, "code_template": "X", "value_prefix": p, "insert_code": False}
        for c, p in (("gender", "GENDER//"), ("region", "REGION//"), ("marital_status", "MARITAL//"))
    ]

    def make():
        events = LoadStaticData(fixtures.static(), "subject_id", columns).fit_transform(fixtures.events())
        untimed = events.withColumn("time", F.when(F.pmod("seq", F.lit(2)) == 0, F.col("time")))
        rows = DemographicSortOrder(["REGION//", "LAB//", "GENDER//"]).apply(build_sequence(untimed))
        df = running_total(rows, F.lit(1), "pos").df
        return sorted(map(tuple, df.select("subject_id", "pos", "code", "text_value", "seq").collect()), key=str)

    plain, cut = both_ways(spark, make)
    assert plain == cut


def test_next_code_translation(spark, fixtures):
    terms, labs, regions = (fixtures.view(v) for v in ("medical_terms", "lab_terms", "region_terms"))

    def make():
        events = fixtures.events().where("code is not null")
        label = F.when(F.pmod("seq", F.lit(3)) == 0, F.lit("high")).otherwise(F.col("code"))
        rows = build_sequence(events.withColumn("code", label))
        rows = NaturalLanguageTranslation(terms, terms, labs, regions, "next_code").apply(rows)
        return sorted(map(tuple, rows.df.select("subject_id", "seq", "code").collect()), key=str)

    plain, cut = both_ways(spark, make)
    assert plain == cut


def test_timelines_decode_and_metrics(spark, fixtures):
    def make():
        rows = standard_tokens(fixtures)
        tokenizer = WordLevel(100).train(rows)
        timelines = materialize(tokenizer.encode(rows), "t")
        metrics = sequence_metrics(timelines, tokenizer.vocab).collect()
        rounded = sorted(
            tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in metrics
        )
        view = subject_timeline(timelines, tokenizer.vocab).select("subject_id", "ts", "gap", "text").collect()
        vocab = sorted(map(tuple, tokenizer.vocab.collect()))
        return merged(timelines, "tokens", "timestamps"), rounded, sorted(map(tuple, view)), vocab

    plain, cut = both_ways(spark, make)
    for one, other in zip(plain, cut):
        assert one == other


def test_byte_pair_timelines(spark, fixtures):
    def make():
        rows = standard_tokens(fixtures)
        return merged(BytePairTokens(90).train(rows).encode(rows), "tokens", "timestamps")

    plain, cut = both_ways(spark, make)
    assert plain == cut


def test_texts_and_words(spark, fixtures):
    def make():
        phrased = phrases(fixtures)
        texts = {}
        for row in sorted(patient_text(phrased).collect(), key=lambda r: (r.subject_id, r.chunk)):
            texts.setdefault(row.subject_id, []).append(row.text_sequence_with_time)
        words = running_total(word_timeline(phrased), F.lit(1), "pos").df
        listed = sorted(map(tuple, words.select("subject_id", "pos", "token", "ts").collect()))
        return {k: " ".join(v) for k, v in texts.items()}, listed

    plain, cut = both_ways(spark, make)
    assert plain == cut


def test_quantiles_of_a_frequent_code(spark):
    values = [(("a" if i % 3 else "b"), float((i * 7919) % 1009) / 8) for i in range(3000)]
    df = spark.createDataFrame(values, "code string, value double")

    def make():
        edges = exact_quantiles(df, ["code"], "value", [0.0, 0.1, 0.5, 0.77, 1.0])
        return {r.code: r.edges for r in edges.collect()}

    plain, cut = both_ways(spark, make, "50")
    assert plain == cut
    import numpy as np

    for code, edges in plain.items():
        mine = [v for c, v in values if c == code]
        assert edges == list(np.quantile(mine, [0.0, 0.1, 0.5, 0.77, 1.0]))


PROBABILITIES = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]


def edge_numbers(kind):
    import numpy as np

    rng = np.random.default_rng(5)
    return {
        "spread": rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700),
        "close": 1.0 + rng.integers(0, 50, 700) * 2.0**-52,
        "signs": np.concatenate([[0.0, -0.0] * 50, rng.integers(-3, 4, 300), [5e-324, -5e-324, 1.7e308, -1.7e308]]),
        "one value": np.full(300, 7.25),
        "whole": rng.integers(-(10**6), 10**6, 900).astype(float),
    }[kind]


def test_selection_by_leading_bits_equals_a_sort(spark, small_groups):
    import numpy as np

    kinds = ["spread", "close", "signs", "one value", "whole"]
    rows = [(k, float(v)) for k in kinds for v in edge_numbers(k)]
    rows += [(None, float(i % 9)) for i in range(100)] + [("few", 1.0), ("few", 2.0), ("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "code string, value double").repartition(5)
    got = {r.code: r.edges for r in exact_quantiles(df, ["code"], "value", PROBABILITIES).collect()}
    assert set(got) == {*kinds, None, "few"}
    for code, edges in got.items():
        mine = np.sort([v for c, v in rows if c == code and v is not None and v == v])
        for p, edge in zip(PROBABILITIES, edges):
            place = (len(mine) - 1) * p
            low, high = mine[int(place)], mine[min(int(place) + 1, len(mine) - 1)]
            t = place - int(place)
            want = low if t == 0 else high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t
            assert edge == want, (code, p)
    assert exact_quantiles(df.where("code = 'none'"), ["code"], "value", [0.5]).count() == 0


def test_a_pass_counts_buckets_not_values(spark):
    """However many distinct values a key has, a pass leaves at most 2 ** DIGIT_BITS counts for each bucket looked into."""
    from pyspark.sql import functions as F

    df = spark.range(200_000).select(F.struct(F.lit("a").alias("code")).alias("_key"), (F.col("id") * 7919 % 199_999 / 8).alias("_value"))
    numbered = df.select("_key", quantiles._order_number()(F.col("_value")).alias("number"), F.lit(1).alias("_n"))
    everything = numbered.select("_key").distinct().withColumn("prefix", F.lit(0).cast("long"))
    first = quantiles.bucket_counts(numbered, everything, quantiles.DIGIT_BITS)
    assert first.count() < 500 and first.agg(F.sum("n")).first()[0] == 200_000
    wanted = first.orderBy(F.desc("n")).limit(2).select("_key", F.col("digit").alias("prefix"))
    second = quantiles.bucket_counts(numbered, wanted, 2 * quantiles.DIGIT_BITS)
    assert 0 < second.count() <= 2 * 2**quantiles.DIGIT_BITS
    plan = second._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan.split("Exchange hashpartitioning")[1]
    assert "partial_sum" in before_exchange and "Sort " not in plan
