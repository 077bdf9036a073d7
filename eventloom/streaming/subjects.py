"""Encoding shards as they arrive where a subject's events are spread over several of them.

Each subject has a state in the stream's state store: the time of the last event that counts as seen
by a gap, the last place in its order, and how many events it has. A micro-batch sorts its own
events of a subject, continues from the state, and writes the subject's next piece: ids and times
without start and end. ``timelines`` puts the pieces together.

Order within a subject is time (untimed first), then ``seq`` where the shards have it, else file
and row. An event that comes before one already taken is late: it is written to ``late`` and changes no
piece. ``settle`` encodes the subjects of late events anew from all shards; from then on their settled
timeline counts, and pieces that came later are no longer used for them until they are settled again.

Runs may have operators that look at one event only, and gaps; operators that insert rows per
subject or reorder need whole subjects (``shards.encode_new_shards``). Memory: a task holds one subject's
events of one micro-batch, which ``files_per_batch`` bounds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from eventloom.operators.sequence import TimeIntervals, sequence_rows
from eventloom.operators.tokens import event_strings
from eventloom.plans.chain import apply_operators
from eventloom.plans.timelines import TimelineRun
from eventloom.schema import BIRTH, NO_TIME, epoch_seconds, event_table
from eventloom.sources.events import path_exists

#: ``plain``: the last event that is no birth; ``seen``: that, or a birth before which a gap was named. NO_TIME: none.
_STATE = "plain long, seen long, last_t long, last_file long, last_seq long, events long"
_KEPT = ["code", "numeric_value", "text_value", "unit", "time", "t_us", "file_key", "seq", "slot"]


def _gaps_of(run: TimelineRun) -> TimeIntervals | None:
    """The run's gap operator; runs that need whole subjects are refused."""
    whole = [type(op).__name__ for op in run.preprocessors if op.inserts]
    whole += [type(op).__name__ for op in run.postprocessors if not isinstance(op, TimeIntervals)]
    if whole or len(run.postprocessors) > 1:
        raise ValueError(f"needs whole subjects: {', '.join(whole) or 'several gap operators'}")
    return run.postprocessors[0] if run.postprocessors else None


def _placed(gaps: TimeIntervals | None):
    """Per subject and micro-batch: the place of every event, and the time that its gap counts from."""
    named = gaps.named() if gaps is not None else (lambda gap: False)

    def place(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plain, seen, last_t, last_file, last_seq, events = state.get if state.exists else (NO_TIME, NO_TIME, NO_TIME, -(2**63), -(2**63), 0)
        last = (last_t, last_file, last_seq)
        rows = pd.concat(list(parts)).sort_values(["t_us", "file_key", "seq"], kind="stable", ignore_index=True)
        seens, places, late = [], [], []
        for t, file, seq, code in zip(rows["t_us"].tolist(), rows["file_key"].tolist(), rows["seq"].tolist(), rows["code"].tolist()):
            if (t, file, seq) < last:
                late.append(True)
                seens.append(None)
                places.append(-1)
                continue
            late.append(False)
            seens.append(None if seen == NO_TIME else seen)
            places.append(events)
            events, last = events + 1, (t, file, seq)
            if t != NO_TIME and code != BIRTH:
                plain = seen = t
            elif t != NO_TIME and plain != NO_TIME and named(t - plain):
                seen = t
        state.update((plain, seen, *last, events))
        yield rows.assign(_seen=pd.array(seens, "Int64"), place=places, late=late)

    return place


def encode_arriving(
    spark: SparkSession, run: TimelineRun, shards: str, schema: StructType, output: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Start a query that encodes all shards not seen yet and then stops."""
    gaps = _gaps_of(run)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(shards)
    if "seq" in schema.names:
        arriving = arriving.withColumn("file_key", F.lit(0).cast("long"))
    else:
        arriving = arriving.select("*", F.xxhash64("_metadata.file_path").alias("file_key"), F.col("_metadata.row_index").alias("seq"))
    events = apply_operators(run.preprocessors, event_table(arriving))
    rows = sequence_rows(events).select("subject_id", *_KEPT)
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    placed = rows.groupBy("subject_id").applyInPandasWithState(
        _placed(gaps), f"{kinds}, _seen long, place long, late boolean", _STATE, "append", GroupStateTimeout.NoTimeout
    )

    def write(batch: DataFrame, number: int) -> None:
        # Under the batch's number, so that one that is repeated after a failure replaces itself.
        batch = batch.persist()
        late = batch.where("late").select("subject_id").distinct()
        late.write.mode("overwrite").parquet(f"{output}/late/batch={number}")
        _pieces(run, gaps, batch.where("not late")).write.mode("overwrite").parquet(f"{output}/pieces/batch={number}")
        batch.unpersist()

    return placed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _pieces(run: TimelineRun, gaps: TimeIntervals | None, rows: DataFrame) -> DataFrame:
    """One row per subject: the ids and times of its events, and the time of its last timed one."""
    df = gaps.with_gaps(rows) if gaps is not None else rows.drop("_seen")
    ts = epoch_seconds()
    tokens = df.select(
        "subject_id", "place", "slot", ts.alias("ts"), F.col("time").isNotNull().alias("timed"),
        F.posexplode_outer(event_strings(run.markers)).alias("part", "token"),
    )
    known = run.tokenizer.token_ids(tokens)
    item = F.when(F.col("token").isNotNull(), F.struct("place", "slot", "part", "ids", "ts"))
    grouped = known.groupBy("subject_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.min("place").alias("first_place"), F.max(F.when(F.col("timed"), F.col("ts"))).alias("end_ts")
    )
    return grouped.select(
        "subject_id", "first_place",
        F.flatten(F.transform("items", lambda i: i["ids"])).alias("tokens"),
        F.flatten(F.transform("items", lambda i: F.array_repeat(i["ts"], F.size(i["ids"])))).alias("timestamps"),
        "end_ts",
    )


def settle(spark: SparkSession, run: TimelineRun, shards: str, schema: StructType, output: str) -> int:
    """Encode the subjects of late events anew from all shards; how many there were."""
    late = spark.read.schema("subject_id long").parquet(f"{output}/late").select("subject_id").distinct()
    n = late.count()
    if n:
        events = event_table(spark.read.schema(schema).parquet(shards))
        rows = run.tokens(events.join(late, "subject_id", "left_semi"))
        run.encode(rows).select("subject_id", "tokens", "timestamps").write.mode("overwrite").parquet(f"{output}/settled")
    return n


def timelines(spark: SparkSession, run: TimelineRun, output: str) -> DataFrame:
    """``subject_id``, ``tokens`` and ``timestamps`` of every subject so far, from its start to its end."""
    start, end = run.tokenizer.edge_ids()
    pieces = spark.read.parquet(f"{output}/pieces").drop("batch")
    settled = None
    if path_exists(spark, f"{output}/settled"):
        settled = spark.read.parquet(f"{output}/settled")
        pieces = pieces.join(settled.select("subject_id"), "subject_id", "left_anti")
    whole = pieces.groupBy("subject_id").agg(
        F.sort_array(F.collect_list(F.struct("first_place", "tokens", "timestamps"))).alias("parts"), F.coalesce(F.max("end_ts"), F.lit(0.0)).alias("end_ts")
    )
    body = lambda name: F.flatten(F.transform("parts", lambda p: p[name]))
    whole = whole.select(
        "subject_id",
        F.concat(F.array(F.lit(start)), body("tokens"), F.array(F.lit(end))).alias("tokens"),
        F.concat(F.array(F.lit(0.0)), body("timestamps"), F.array("end_ts")).alias("timestamps"),
    )
    return whole if settled is None else whole.unionByName(settled)


# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
