"""Stored layouts: joins of bucketed tables without an exchange, and lookups that open few files."""

import pytest
from pyspark.sql import functions as F

from eventloom.reports.narratives import narrative_dataset
from eventloom.reports.subjects import look_up_subject, subject_timeline, validate_subjects
from eventloom.sources.events import read_timelines
from eventloom.sources.file_index import FileIndex, describe_files
from eventloom.sources.layout import read_bucketed, write_bucketed
from eventloom.sources.sinks import write_timelines


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def timelines(spark, n=200):
    rows = [(i, "train", 0, [1, 2, 3 + i % 4], [0.0, 1.0, float(i)]) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id bigint, split string, chunk int, tokens array<int>, timestamps array<double>")


def labels(spark, n=200):
    rows = [(i, i % 2, "lung" if i % 2 else None, "2024-02-03" if i % 3 else "bad") for i in range(0, n, 3)] + [(5000, 0, None, None)]
    return spark.createDataFrame(rows, "subject_id bigint, is_case int, site string, cancerdate string")


def test_ids_are_compared_without_an_exchange(spark, tmp_path, no_broadcast):
    write_bucketed(timelines(spark), f"{tmp_path}/a")
    write_bucketed(labels(spark), f"{tmp_path}/b")
    found = validate_subjects(read_bucketed(spark, f"{tmp_path}/a"), read_bucketed(spark, f"{tmp_path}/b"))
    assert "Exchange" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, validate_subjects(timelines(spark), labels(spark)).collect()))


def test_narratives_join_labels_without_an_exchange_of_subjects(spark, tmp_path, no_broadcast):
    write_timelines(timelines(spark), f"{tmp_path}/t", by_subject=True)
    write_bucketed(labels(spark).withColumn("file_order", F.lit(1)), f"{tmp_path}/l")
    phrases = spark.createDataFrame([(i, f"phrase {i}") for i in range(8)], "token int, phrase string")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")  # the few names of sites may be sent to all
    stored = narrative_dataset(read_timelines(spark, f"{tmp_path}/t"), phrases, read_bucketed(spark, f"{tmp_path}/l"))
    plan = plan_of(stored)
    assert "hashpartitioning(subject_id" not in plan and "Exchange SinglePartition" not in plan.split("Join")[0]
    plain = narrative_dataset(timelines(spark), phrases, labels(spark).withColumn("file_order", F.lit(1)))
    key = lambda df: sorted((r.subject_id, r.text, r.label, r.cancer_date) for r in df.collect())
    assert key(stored) == key(plain) and len(key(plain)) > 50


def test_another_session_opens_the_folder(spark, tmp_path, no_broadcast):
    write_bucketed(timelines(spark), f"{tmp_path}/a", buckets=7)
    for t in spark.catalog.listTables():
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    again = read_bucketed(spark, f"{tmp_path}/a")
    assert again.schema == timelines(spark).schema
    assert "Exchange" not in plan_of(again.groupBy("subject_id").count()) and again.count() == 200
    assert len(again.inputFiles()) == 7


def test_write_modes_of_buckets(spark, tmp_path):
    write_bucketed(timelines(spark, 5), f"{tmp_path}/a")
    with pytest.raises(FileExistsError):
        write_bucketed(timelines(spark, 6), f"{tmp_path}/a")
    write_bucketed(timelines(spark, 6), f"{tmp_path}/a", mode="ignore")
    assert read_bucketed(spark, f"{tmp_path}/a").count() == 5
    write_bucketed(timelines(spark, 6), f"{tmp_path}/a", mode="overwrite")
    assert read_bucketed(spark, f"{tmp_path}/a").count() == 6
    write_bucketed(timelines(spark, 0), f"{tmp_path}/none")
    assert read_bucketed(spark, f"{tmp_path}/none").count() == 0


@pytest.fixture
def indexed(spark, tmp_path):
    """Twelve files whose ids are spread, so that ranges alone tell nothing."""
    df = timelines(spark, 3000).withColumn("subject_id", F.when(F.col("subject_id") % 500 != 499, F.col("subject_id") * 17))
    df.repartition(12, F.col("tokens")[2], F.col("subject_id") % 3).write.partitionBy("split").parquet(f"{tmp_path}/t")
    return FileIndex(spark, f"{tmp_path}/t", f"{tmp_path}/index").build()


def test_a_lookup_opens_the_files_that_hold_the_subject(spark, indexed):
    everything = spark.read.parquet(indexed.root)
    holders = {}
    for row in everything.where("subject_id is not null").select("subject_id", F.input_file_name().alias("file")).collect():
        holders.setdefault(row.subject_id, set()).add(row.file.rpartition("/")[2])
    total = len(everything.inputFiles())
    opened = wrong = 0
    for subject in [0, 17, 17 * 2999 - 17 * 2, *range(17 * 40, 17 * 60, 17)]:
        found = {f.rpartition("/")[2] for f in indexed.files(subject)}
        assert holders.get(subject, set()) <= found
        opened, wrong = opened + len(found), wrong + len(found - holders.get(subject, set()))
        rows = indexed.read(subject)
        assert {f.rpartition("/")[2] for f in rows.inputFiles()} == found and len(found) < total
        assert rows.count() == everything.where(F.col("subject_id") == subject).count()
        assert rows.columns == everything.columns
    assert wrong <= 6 and opened <= 40
    assert indexed.read(1).count() == 0 and indexed.files(-5) == []


def test_new_files_are_indexed_alone(spark, indexed):
    more = timelines(spark, 3).withColumn("subject_id", F.col("subject_id") + 10**9)
    more.coalesce(1).write.mode("append").partitionBy("split").parquet(indexed.root)
    before = indexed.table().select("file").distinct().count()
    assert indexed.files(10**9) == [] and indexed.refresh() == 1
    assert indexed.table().select("file").distinct().count() == before + 1
    assert len(indexed.files(10**9)) == 1 and indexed.refresh() == 0


def test_filters_of_many_keys_have_several_pages(spark, tmp_path):
    spark.range(20_000).select((F.col("id") * 3).alias("subject_id")).coalesce(1).write.parquet(f"{tmp_path}/many")
    index = FileIndex(spark, f"{tmp_path}/many", f"{tmp_path}/index").build()
    pages = index.table().select("pages", "page").collect()
    assert len(pages) == 7 and {p.page for p in pages} == set(range(7))
    assert all(index.files(3 * i) for i in range(0, 20_000, 3500))
    missing = [index.files(3 * i + 1) for i in range(0, 20_000, 1500)]
    assert sum(map(bool, missing)) <= 2
    assert describe_files(spark.read.parquet(f"{tmp_path}/many").where("false"), "subject_id").count() == 0


def test_a_subject_looked_up_equals_the_subject_among_all(spark, indexed):
    vocab = spark.createDataFrame([(i, f"code {i}") for i in range(7)], "token int, str string")
    everything = spark.read.parquet(indexed.root)
    want = subject_timeline(everything, vocab, subject_id=17 * 50).select("ts", "gap", "text").collect()
    got = look_up_subject(indexed, vocab, 17 * 50).select("ts", "gap", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
