"""Shards that arrive later are encoded like the rest, each once."""

import pytest
from pyspark.sql import functions as F

from eventloom.plans.timelines import TimelineRun
from eventloom.streaming.shards import encode_new_shards
from eventloom.streaming.subjects import encode_arriving, settle, timelines
from tests.test_sources import CONFIG


def test_new_shards_are_encoded_once(spark, fixtures, tmp_path):
    events = fixtures.events()
    run = TimelineRun.from_config(CONFIG)
    whole = {r.subject_id: (r.tokens, r.timestamps) for r in run.run(events).collect()}
    shards, out, done = (f"{tmp_path}/{name}" for name in ("shards", "out", "done"))
    schema = events.drop("split").schema

    def arrive(condition: str) -> None:
        events.where(condition).drop("split").coalesce(1).write.mode("append").parquet(shards)
        encode_new_shards(spark, run, shards, schema, out, done).awaitTermination()

    arrive("subject_id % 2 = 0")
    first = spark.read.parquet(out).count()
    arrive("subject_id % 2 = 1")
    rows = spark.read.parquet(out).collect()
    assert 0 < first < len(rows) == len(whole)
    assert {r.subject_id: (r.tokens, r.timestamps) for r in rows} == whole


MAIN = {
    "preprocessing": [{"type": "quantile_bin", "matching_type": "starts_with", "matching_value": "LAB", "k": 4, "value_column": "numeric_value"}],
    "postprocessing": [{"type": "time_interval", "use_dynamic_bucketing": True, "interval_tokens": None, "dataset": "MIMIC"}],
    "tokenization": {"tokenizer": "word_level", "vocab_size": 80, "insert_event_tokens": True, "insert_numeric_tokens": False, "insert_text_tokens": False},
}


class Stream:
    """Shards of one folder and what a run makes of them."""

    def __init__(self, spark, run, folder, schema, files_per_batch=1000):
        self.spark, self.run, self.schema, self.files = spark, run, schema, files_per_batch
        self.shards, self.out, self.done = (f"{folder}/{name}" for name in ("shards", "out", "done"))

    def arrive(self, events, files=1):
        events.drop("split").select(self.schema.names).coalesce(files).write.mode("append").parquet(self.shards)
        encode_arriving(self.spark, self.run, self.shards, self.schema, self.out, self.done, self.files).awaitTermination()

    def rows(self):
        return {r.subject_id: (r.tokens, r.timestamps) for r in timelines(self.spark, self.run, self.out).collect()}


def trained(events, config=MAIN):
    run = TimelineRun.from_config(config)
    run.train(run.fit(events).tokens(events))
    return run, {r.subject_id: (r.tokens, r.timestamps) for r in run.encode(run.tokens(events)).collect()}


@pytest.mark.parametrize("tokenizer, size", [("word_level", 80), ("bpe", 115)])
def test_subjects_spread_over_shards(spark, fixtures, tmp_path, tokenizer, size):
    events = fixtures.events()
    run, whole = trained(events, {**MAIN, "tokenization": {**MAIN["tokenization"], "tokenizer": tokenizer, "vocab_size": size}})
    stream = Stream(spark, run, tmp_path, events.drop("split").schema)
    middle = events.agg(F.percentile_approx("time", 0.5)).first()[0]
    first = F.col("time").isNull() | (F.col("time") < F.lit(middle))
    stream.arrive(events.where(first), files=3)
    assert set(stream.rows()) <= set(whole)
    stream.arrive(events.where(~first))
    assert stream.rows() == whole
    stream.arrive(events.where("false"))
    assert stream.rows() == whole and settle(spark, run, stream.shards, stream.schema, stream.out) == 0


def test_late_events_change_no_piece_until_settled(spark, fixtures, tmp_path):
    events = fixtures.events()
    run, whole = trained(events)
    stream = Stream(spark, run, tmp_path, events.drop("split").schema)
    middle = events.agg(F.percentile_approx("time", 0.5)).first()[0]
    first = F.col("time").isNull() | (F.col("time") < F.lit(middle))
    stream.arrive(events.where(~first))
    before = stream.rows()
    stream.arrive(events.where(first))
    after = stream.rows()
    both = events.groupBy("subject_id").agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b")).where("a > 0 and b > 0")
    late = {r.subject_id for r in both.collect()}
    assert late and all(after[s] == before[s] != whole[s] for s in late)
    assert {s: rows for s, rows in after.items() if s not in late} == {s: rows for s, rows in whole.items() if s not in late}
    assert settle(spark, run, stream.shards, stream.schema, stream.out) == len(late)
    assert stream.rows() == whole


def test_shards_without_an_order_of_their_own(spark, make_events, tmp_path):
    rows = [(1, None, "STATIC", None, None), (1, "1990-01-01", "MEDS_BIRTH", None, None), (1, "2020-01-01 10:00:00", "LAB//1", 4.0, None)]
    rows += [(1, "2020-01-01 10:00:00", "LAB//2", 5.0, None), (1, "2020-01-03 10:00:00", "MEDS_BIRTH", None, None), (1, "2020-01-03 10:03:00", None, None, "x")]
    rows += [(1, "2020-01-03 10:03:00", "MEDS_BIRTH", None, None), (1, "2020-02-01", "LAB//1", None, None), (2, "2020-01-01", "LAB//1", 1.0, None)]
    events = make_events(rows).withColumn("split", F.lit("train"))
    run, whole = trained(events)
    stream = Stream(spark, run, tmp_path, events.drop("split", "seq").schema)
    for i in range(len(rows)):  # every event a shard of its own: all gaps come from the state
        stream.arrive(events.where(F.col("seq") == i))
    assert stream.rows() == whole


def test_runs_that_need_whole_subjects_are_refused(spark, fixtures, tmp_path):
    run = TimelineRun.from_config({**MAIN, "postprocessing": [{"type": "demographic_sort_order", "token_patterns": ["A"]}]})
    with pytest.raises(ValueError, match="DemographicSortOrder"):
        encode_arriving(spark, run, str(tmp_path), fixtures.events().schema, "x", "y")
