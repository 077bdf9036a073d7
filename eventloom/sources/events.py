"""Event shards, text columns and timelines in Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.schema import event_table
from eventloom.session import spread
from eventloom.sources.tables import ROW_ORDER, read_table

EVENT_SPLITS = ("train", "tuning", "held_out")
TEXT_SPLITS = ("train", "test")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _hadoop_path(spark, path)
    return files.exists(place)


def check_shards(spark: SparkSession, folder: str) -> None:
    """A split folder must exist and hold only Parquet files."""
    files, place = _hadoop_path(spark, folder)
    if not files.exists(place):
        raise FileNotFoundError(f"Directory {folder} not found")
    names = [status.getPath().getName() for status in files.listStatus(place)]
    # Spark's own job markers are not data.
    wrong = [n for n in names if not n.endswith(".parquet") and not n.startswith(("_", "."))]
    if wrong:
        raise ValueError(f"{folder} holds files that are not Parquet: {wrong[:5]}")


def read_split_files(
    spark: SparkSession, root: str, splits: tuple[str, ...], required: bool
) -> DataFrame:
    """All shards of the split folders as one table with a ``split`` column."""
    parts = []
    for split in splits:
        folder = f"{root.rstrip('/')}/{split}"
        if not required and not path_exists(spark, folder):
            continue
        check_shards(spark, folder)
        parts.append(spark.read.parquet(folder).withColumn("split", F.lit(split)))
    if not parts:
        raise FileNotFoundError(f"none of {splits} found under {root}")
    return spread(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def read_events(spark: SparkSession, root: str, splits: tuple[str, ...] = EVENT_SPLITS) -> DataFrame:
    """Event table of the three required splits."""
    parts = []
    for split in splits:
        folder = f"{root.rstrip('/')}/{split}"
        check_shards(spark, folder)
        parts.append(event_table(spark.read.parquet(folder)).withColumn("split", F.lit(split)))
    return spread(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def read_text_splits(spark: SparkSession, root: str) -> DataFrame:
    """Text tables of ``train`` and ``test``; a missing folder is skipped."""
    return read_split_files(spark, root, TEXT_SPLITS, required=False)


def text_column(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """One text column without nulls and empty texts; other columns are never read."""
    return rows.select(*keep, column).where(F.col(column) != "")


def in_splits(rows: DataFrame, splits: list[str] | tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("split").isin(list(splits)))


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """Timelines however they are laid out."""
    from eventloom.sources.layout import is_bucketed, read_bucketed

    return read_bucketed(spark, path) if is_bucketed(spark, path) else spark.read.parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``vocab.csv``; cells such as ``None`` or ``NA`` stay literal text."""
    return spark.read.csv(
        path, header=True, schema="token int, str string, count bigint", escape='"', multiLine=True,
        nullValue="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def subject_labels(labels: DataFrame) -> DataFrame:
    """Label table with ``cancerdate`` parsed; what is not a date becomes null."""
    return labels.withColumn("cancerdate", F.col("cancerdate").try_cast("timestamp"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    schema = "subject_id bigint, is_case int, site string, cancerdate string"
    raw = read_table(spark, path)
    columns = [f.strip().split(" ") for f in schema.split(",")]
    cells = [F.col(name).cast("string").try_cast(kind).alias(name) for name, kind in columns]
    return subject_labels(raw.select(*cells, ROW_ORDER))
