"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Epoch seconds, dates and text of timestamps are all taken in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows may hold whole texts: what goes to Python at once is bounded by its bytes, not only by its rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every job here relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would not survive the loss of an executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="eventloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_RUN_FOLDERS: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. It goes with the application: what is to stay is written elsewhere."""
    folder = f"{scratch_root(spark)}/eventloom-{spark.sparkContext.applicationId}"
    if folder not in _RUN_FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUN_FOLDERS.add(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch area and read it back.

    Cuts the lineage on storage that outlives executors, and gives Catalyst the
    true size of the result, so it broadcasts a fitted table only when it is
    really below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scanned table that comes in fewer splits than there are cores out over all of them.

    Parsing and formatting text is narrow but heavy work. A large table already
    has more splits than cores and keeps its layout: no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
