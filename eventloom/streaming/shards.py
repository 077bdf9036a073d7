"""Encoding event shards as they arrive, with a fitted and trained run.

A shard holds whole subjects, so each micro-batch of new files is encoded like a
small table, and the row's place in its file orders a subject's events (``subjects``
encodes subjects that are spread over shards). The checkpoint remembers which files are done; a batch is written
under its number, so one that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from eventloom.plans.timelines import TimelineRun
from eventloom.schema import event_table
from eventloom.sources.sinks import write_timelines


def encode_new_shards(
    spark: SparkSession,
    run: TimelineRun,
    shards: str,
    schema: StructType,
    output: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Start a query that encodes all shards not seen yet and then stops."""
    arriving = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(shards)
        .select("*", "_metadata.row_index")
    )

    def encode(batch: DataFrame, number: int) -> None:
        events = batch if "seq" in batch.columns else batch.withColumn("seq", F.col("row_index"))
        rows = run.tokens(event_table(events.drop("row_index")))
        write_timelines(run.encode(rows), f"{output}/batch={number}", "overwrite")

    return (
        arriving.writeStream.foreachBatch(encode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
