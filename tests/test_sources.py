"""Readers, writers and whole runs from files."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators.base import Operator
from eventloom.plans.chain import fit_operators
from eventloom.plans.registry import build_postprocessors, build_preprocessors, build_tokenizer
from eventloom.plans.timelines import run_config
from eventloom.session import scratch_root
from eventloom.sources.events import check_shards, read_events, read_text_splits, read_vocab
from eventloom.sources.sinks import write_shards, write_timelines, write_vocab


def test_missing_split_and_foreign_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_events(spark, str(tmp_path))
    folder = tmp_path / "train"
    folder.mkdir()
    (folder / "notes.txt").write_text("x")
    with pytest.raises(ValueError):
        check_shards(spark, str(folder))
    with pytest.raises(FileNotFoundError):
        read_text_splits(spark, str(tmp_path / "none"))


def test_source_order_is_the_row_order_of_a_shard(spark, tmp_path):
    df = spark.range(50).select(
        F.lit(1).alias("subject_id"), F.lit(None).cast("timestamp").alias("time"), F.concat(F.lit("c"), "id").alias("code"),
        F.lit(1.0).cast("float").alias("numeric_value"),
    )
    for split in ("train", "tuning", "held_out"):
        df.coalesce(1).write.parquet(f"{tmp_path}/{split}")
    events = read_events(spark, str(tmp_path))
    assert events.schema["numeric_value"].dataType.simpleString() == "double"
    train = events.where("split = 'train'").orderBy("seq").collect()
    assert [r.code for r in train] == [f"c{i}" for i in range(50)]


def test_vocab_csv_keeps_odd_strings(spark, tmp_path):
    rows = [(0, "<unknown>", 3), (1, 'a "quoted", one', 1), (2, "None", 2), (3, "NA", 2), (4, " spaced ", 1), (5, "two\nlines", 1)]
    vocab = spark.createDataFrame(rows, "token int, str string, count bigint")
    write_vocab(vocab, f"{tmp_path}/vocab.csv")
    assert sorted(map(tuple, read_vocab(spark, f"{tmp_path}/vocab.csv").collect())) == rows


def test_existing_output_fails_unless_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, [1], [0.0], "train")], "subject_id bigint, tokens array<int>, timestamps array<double>, split string")
    write_timelines(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="already exists"):
        write_timelines(df, f"{tmp_path}/t")
    write_timelines(df, f"{tmp_path}/t", "overwrite")


CONFIG = {
    "name": "small",
    "preprocessing": [
        {"type": "quantile_bin", "matching_type": "starts_with", "matching_value": "LAB", "k": 4, "value_column": "numeric_value"},
        {"type": "raw_age", "keep_meds_birth": False, "decimals": 0},
    ],
    "postprocessing": [{"type": "time_interval", "use_dynamic_bucketing": True, "interval_tokens": {}, "dataset": "MIMIC"}],
    "tokenization": {"tokenizer": "word_level", "vocab_size": 200, "insert_event_tokens": False, "insert_numeric_tokens": False, "insert_text_tokens": False},
}


def test_run_from_files(spark, fixtures, tmp_path):
    write_shards(fixtures.events(), f"{tmp_path}/data")
    config = {**CONFIG, "data": {"path": f"{tmp_path}/data"}, "save_path": f"{tmp_path}/out"}
    target = run_config(spark, config, "first")
    timelines = spark.read.parquet(f"{target}/timelines")
    assert timelines.select("subject_id").distinct().count() == fixtures.events().select("subject_id").distinct().count()
    assert timelines.where("size(tokens) <> size(timestamps)").count() == 0
    assert timelines.where("tokens[0] <> 1 or element_at(tokens, -1) <> 2").count() == 0
    vocab = read_vocab(spark, f"{target}/vocab.csv")
    counted = timelines.where("split = 'train'").select(F.explode("tokens").alias("token")).where("token not in (1, 2)").count()
    assert vocab.agg(F.sum("count")).first()[0] == counted
    with pytest.raises(Exception, match="already exists"):
        run_config(spark, config, "first")


def test_result_does_not_depend_on_partitions(spark, fixtures):
    from eventloom.plans.timelines import TimelineRun

    seen = set()
    for parts in (1, 4, 16):
        run = TimelineRun.from_config(CONFIG)
        rows = run.run(fixtures.events().repartition(parts)).collect()
        seen.add(json.dumps(sorted((r.subject_id, r.tokens, r.timestamps) for r in rows)))
    assert len(seen) == 1


def test_registry_covers_every_type():
    from eventloom.plans.registry import POSTPROCESSORS, PREPROCESSORS, TOKENIZERS

    assert (len(PREPROCESSORS), len(POSTPROCESSORS), len(TOKENIZERS)) == (13, 4, 3)
    assert all(issubclass(op, Operator) for op in PREPROCESSORS.values())
    with pytest.raises(ValueError):
        build_preprocessors([{"type": "nothing"}])
    with pytest.raises(ValueError):
        build_postprocessors([{"type": "nothing"}])
    with pytest.raises(ValueError):
        build_tokenizer({"tokenizer": "nothing", "vocab_size": 5})


def test_bins_before_enrichment_warn_and_prefix_mode_bins(spark, fixtures):
    labs = fixtures.labitems()
    configs = [
        CONFIG["preprocessing"][0],
        {"type": "code_enrichment", "matching_type": "starts_with", "matching_value": "LAB//", "lookup_file": labs,
         "template": "{label}", "code_column": "itemid"},
    ]
    events = fixtures.events()
    with pytest.warns(UserWarning, match="stay unbinned"):
        joint = fit_operators(build_preprocessors(configs), events)
    known = "code in ('LAB//1//mg/dL')"
    assert joint[0].fitted.where(known).count() == 0
    prefix = fit_operators(build_preprocessors(configs), events, "prefix")
    assert prefix[0].fitted.where(known).count() == 1


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
