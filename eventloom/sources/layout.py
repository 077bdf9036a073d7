"""Tables stored in buckets of their subjects, so that joins by subject read them without an exchange.

The data are Parquet files; ``_layout`` beside them says how they are dealt, so that another
session can open them by their folder alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from eventloom.sources.events import path_exists

SUBJECT = "subject_id"


def _table_name(path: str) -> str:
    return "eventloom_" + hashlib.md5(path.encode()).hexdigest()


def bucket_count(spark: SparkSession) -> int:
    """Tables that are to be joined need one number: by default that of the session's shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: str = SUBJECT, buckets: int | None = None, mode: str = "errorifexists") -> None:
    """Write ``df`` in buckets of ``key``, one sorted file each.

    A subject is one bucket's, so the sink suits tables of one row per subject and tables whose
    subjects are small; events of very large subjects belong into range-partitioned shards.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if path_exists(spark, path):
        if mode == "ignore":
            return
        if mode == "errorifexists":
            raise FileExistsError(path)
    name, buckets = _table_name(path), buckets or bucket_count(spark)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # One task per bucket: as many files as buckets.
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    layout = [(key, buckets, df._jdf.schema().toDDL())]
    spark.createDataFrame(layout, "key string, buckets int, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")


def is_bucketed(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path.rstrip('/')}/_layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    path = path.rstrip("/")
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.json(f"{path}/_layout").first()
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({layout['columns']}) USING parquet CLUSTERED BY ({layout['key']}) "
            f"SORTED BY ({layout['key']}) INTO {layout['buckets']} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)
