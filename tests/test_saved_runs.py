"""A saved run encodes other events as the one that learned does."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators.codes import CodeEnrichment
from eventloom.plans.timelines import TimelineRun

PLAIN = {"insert_event_tokens": False, "insert_numeric_tokens": False, "insert_text_tokens": False}
STEPS = {
    "preprocessing": [
        {"type": "quantile_bin", "matching_type": "starts_with", "matching_value": "LAB", "k": 4, "value_column": "numeric_value"}
    ],
    "postprocessing": [{"type": "time_interval", "use_dynamic_bucketing": True, "interval_tokens": None, "dataset": "MIMIC"}],
}


@pytest.mark.parametrize("tokenizer, size", [("word_level", 60), ("bpe", 115), ("hf_bpe", 90)])
def test_timelines_of_a_loaded_run(spark, fixtures, tmp_path, tokenizer, size):
    config = {**STEPS, "tokenization": {"tokenizer": tokenizer, "vocab_size": size, **PLAIN}}
    events = fixtures.events()
    run = TimelineRun.from_config(config)
    want = {r.subject_id: (r.tokens, r.timestamps) for r in run.run(events).collect()}
    run.save(spark, f"{tmp_path}/run")
    other = TimelineRun.load(spark.newSession(), config, f"{tmp_path}/run")
    got = {r.subject_id: (r.tokens, r.timestamps) for r in other.encode(other.tokens(events)).collect()}
    assert got == want


def test_integer_keys_survive(spark, make_events, tmp_path):
    lookup = spark.createDataFrame([(7, "seven")], "itemid bigint, label string")
    events = make_events([(1, "2020-01-01", "LAB//007//mg", 1.0, None), (1, "2020-01-02", None, None, None)])
    learned = CodeEnrichment("starts_with", "LAB//", lookup, "<{label}>", "itemid").fit(events)
    learned.save_fit(f"{tmp_path}/fit")
    loaded = CodeEnrichment("starts_with", "LAB//", lookup, "<{label}>", "itemid").load_fit(spark, f"{tmp_path}/fit")
    shown = lambda op: [r.code for r in op.transform(events).orderBy(F.col("time")).collect()]
    assert shown(loaded) == shown(learned)
    assert loaded.key_type == learned.key_type
