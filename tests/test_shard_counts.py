"""Counts per shard against counting everything, and what an update reads."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators.filters import TopKCodes
from eventloom.operators.values import QuantileBin, QuantileBin3Level
from eventloom.operators.word_vocab import WordLevel, token_counts
from eventloom.plans.chain import fit_operators
from eventloom.plans.shard_counts import ShardCounts, codes, fit_values, tokens_of, values_of
from eventloom.plans.timelines import TimelineRun
from tests.test_streaming import MAIN


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def code_counts(events):
    return shown(events.groupBy("code").agg(F.count(F.lit(1)).alias("n")))


@pytest.fixture
def shards(spark, fixtures, tmp_path):
    """Events, and a function that writes those of a condition as more shards."""
    events = fixtures.events().drop("split")
    folder = f"{tmp_path}/shards"

    def arrive(condition, files=2):
        events.where(condition).repartition(files, "subject_id").write.mode("append").parquet(folder)

    return events, arrive, folder


def test_an_update_reads_new_shards_only(spark, shards, tmp_path):
    events, arrive, folder = shards
    store = ShardCounts(spark, folder, f"{tmp_path}/counts", codes)
    assert store.update().files == 0
    arrive("subject_id % 3 = 0")
    first = store.update()
    assert first.rows == events.where("subject_id % 3 = 0").count() and first.files == 2
    assert store.update().files == 0
    assert shown(store.merged().select("code", "n")) == code_counts(events.where("subject_id % 3 = 0"))
    arrive("subject_id % 3 <> 0", files=3)
    second = store.update()
    assert second.rows == events.where("subject_id % 3 <> 0").count() and second.files == 3
    assert shown(store.merged().select("code", "n")) == code_counts(events)


def test_files_written_again_or_gone(spark, shards, tmp_path):
    import os
    from glob import glob

    events, arrive, folder = shards
    store = ShardCounts(spark, folder, f"{tmp_path}/counts", codes)
    arrive("true", files=3)
    store.update()
    files = sorted(glob(f"{folder}/*.parquet"))
    other = f"{tmp_path}/other"
    events.where("code is null").coalesce(1).write.parquet(other)
    os.replace(glob(f"{other}/*.parquet")[0], files[0])
    for crc in glob(f"{folder}/.*.crc"):
        os.remove(crc)
    os.remove(files[1])
    now = spark.read.parquet(folder)
    assert store.update().files == 1
    assert shown(store.merged().select("code", "n")) == code_counts(now)


def test_an_update_that_failed_counts_for_nothing(spark, shards, tmp_path):
    events, arrive, folder = shards
    arrive("true")
    path = f"{tmp_path}/counts"
    # Counts without their manifest, as a lost driver leaves them.
    spark.createDataFrame([("file:/gone", "x", 5)], "_file string, code string, n bigint").write.parquet(f"{path}/counts/update=0")
    store = ShardCounts(spark, folder, path, codes)
    store.update()
    assert shown(store.merged().select("code", "n")) == code_counts(events)


def test_fits_from_counts_equal_fits_from_events(spark, shards, tmp_path):
    events, arrive, folder = shards
    ops = [QuantileBin("starts_with", "LAB//", 4, "numeric_value"), QuantileBin3Level("starts_with", "MEDICAL//", "numeric_value")]
    store = ShardCounts(spark, folder, f"{tmp_path}/values", values_of(ops))
    for part in ("subject_id % 2 = 0", "subject_id % 2 = 1"):
        arrive(part)
        store.update()
    fit_values(ops, store.merged())
    plain = [QuantileBin("starts_with", "LAB//", 4, "numeric_value"), QuantileBin3Level("starts_with", "MEDICAL//", "numeric_value")]
    fit_operators(plain, events)
    assert [shown(op.fitted) for op in ops] == [shown(op.fitted) for op in plain]
    counts = ShardCounts(spark, folder, f"{tmp_path}/codes", codes)
    counts.update()
    kept = TopKCodes("starts_with", "LAB//", 3).fit_counts(counts.merged())
    assert shown(kept.fitted) == shown(TopKCodes("starts_with", "LAB//", 3).fit(events).fitted)


def test_weights_stand_for_repeated_values(spark, small_groups):
    from eventloom.functions.quantiles import exact_quantiles

    rows = [("a", float(i * 37 % 101), 1 + i % 5) for i in range(90)] + [("b", 2.0, 3), ("b", 5.0, 1), ("b", None, 9)]
    df = spark.createDataFrame(rows, "code string, value double, n int")
    each = df.select("code", "value", F.explode(F.sequence(F.lit(1), "n")))
    asked = [0.0, 0.3, 0.5, 0.99, 1.0]
    assert shown(exact_quantiles(df, ["code"], "value", asked, weight="n")) == shown(exact_quantiles(each, ["code"], "value", asked))


def test_vocabulary_from_token_counts(spark, shards, tmp_path):
    events, arrive, folder = shards
    run = TimelineRun.from_config(MAIN).fit(events)
    store = ShardCounts(spark, folder, f"{tmp_path}/tokens", tokens_of(run))
    for part in ("subject_id % 2 = 0", "subject_id % 2 = 1"):
        arrive(part)
        store.update()
    learned = WordLevel(60).train_counts(store.merged().withColumnRenamed("n", "count"))
    plain = WordLevel(60).train_counts(token_counts(run.tokens(events).df))
    assert shown(learned.vocab) == shown(plain.vocab)
