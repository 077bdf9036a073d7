"""Looking at subjects: id reconciliation, shard index, one subject's timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.gaps import elapsed_text
from eventloom.operators.word_vocab import with_strings
from eventloom.ordering import last_before, order_groups
from eventloom.schema import BIRTH
from eventloom.sources.file_index import FileIndex


def validate_subjects(raw: DataFrame, tokenized: DataFrame) -> DataFrame:
    """Ids on one side only: ``missing`` from the output, or ``extra`` in it."""
    before = raw.select("subject_id").distinct()
    after = tokenized.select("subject_id").distinct()
    missing = before.join(after, "subject_id", "left_anti").withColumn("status", F.lit("missing"))
    extra = after.join(before, "subject_id", "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def validation_summary(raw: DataFrame, tokenized: DataFrame) -> DataFrame:
    """Counts of both sides and of the differences."""
    sides = raw.select("subject_id", F.lit(1).alias("r"), F.lit(0).alias("t")).unionByName(
        tokenized.select("subject_id", F.lit(0).alias("r"), F.lit(1).alias("t"))
    )
    per_id = sides.groupBy("subject_id").agg(F.max("r").alias("r"), F.max("t").alias("t"))
    return per_id.agg(
        F.sum("r").alias("raw_subjects"),
        F.sum("t").alias("tokenized_subjects"),
        F.count_if(F.expr("r = 1 and t = 0")).alias("missing"),
        F.count_if(F.expr("r = 0 and t = 1")).alias("extra"),
    )


def shard_index(timelines: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Shard files of every subject's timeline and, where there are any, of its notes: one row per pair of files.

    Both tables must be read straight from files.
    """

    def shards(df: DataFrame, name: str) -> DataFrame:
        return df.select("subject_id", F.input_file_name().alias(name)).distinct()

    index = shards(timelines, "ehr_shard_filepath")
    if notes is None:
        return index.withColumn("clinical_note_shard_filepath", F.lit(None).cast("string"))
    return index.join(shards(notes, "clinical_note_shard_filepath"), "subject_id", "left")


def look_up_subject(timelines: FileIndex, vocab: DataFrame, subject_id: int, notes: FileIndex | None = None) -> DataFrame:
    """``subject_timeline`` of one subject, reading only files that may hold it."""
    return subject_timeline(timelines.read(subject_id), vocab, None if notes is None else notes.read(subject_id))


def subject_timeline(
    timelines: DataFrame, vocab: DataFrame, notes: DataFrame | None = None, subject_id: int | None = None
) -> DataFrame:
    """Tokens and notes in time order with the time passed, for one subject or for all.

    ``gap``: ``None`` for untimed rows, ``T0`` for the birth, ``-`` at the same
    time as the row before, else the time since it (since birth for the first).
    """
    if subject_id is not None:
        timelines = timelines.where(F.col("subject_id") == subject_id)
        notes = None if notes is None else notes.where(F.col("subject_id") == subject_id)
    keys = [c for c in timelines.columns if c in ("subject_id", "split")]
    named = with_strings(timelines.select(*keys, "chunk", "tokens", "timestamps"), vocab.select("token", "str"))
    tokens = named.select(*keys, "chunk", F.posexplode(F.arrays_zip("strings", "timestamps")).alias("pos", "t"))
    events = tokens.where("t.strings is not null").select(
        *keys, F.lit("ehr").alias("kind"), F.lit(0).alias("source"), F.struct("chunk", "pos").alias("place"),
        F.col("t.timestamps").alias("ts"), F.col("t.strings").alias("text"),
    )
    rows = events
    if notes is not None:
        subjects = timelines.select(*keys).distinct()
        at = F.unix_micros(F.col("charttime").cast("timestamp")) / F.lit(1e6)
        rows = events.unionByName(
            notes.join(subjects, "subject_id").select(
                *keys, F.lit("note").alias("kind"), F.lit(1).alias("source"),
                F.struct(F.lit(0).alias("chunk"), F.coalesce("note_order", F.lit(0)).cast("int").alias("pos")).alias("place")
                if "note_order" in notes.columns
                else F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("pos")).alias("place"),
                at.alias("ts"), "text",
            )
        )
    is_birth = (F.col("kind") == "ehr") & (F.col("text") == BIRTH)
    births = events.where(is_birth).groupBy(*keys).agg(F.min_by("ts", "place").alias("birth"))
    rows = rows.withColumn("timed", (F.col("ts") != 0).cast("int"))
    ordered = order_groups(rows, keys, ["timed", "ts", "source", "place"])
    ordered = last_before(ordered, F.col("ts"), "before")
    df = ordered.df.join(births, keys, "left")
    since_birth = F.when(F.col("birth") != 0, elapsed_text(F.col("ts") - F.col("birth")))
    gap = (
        F.when(F.col("ts") == 0, F.lit("None"))
        .when(is_birth, F.lit("T0"))
        .when(F.col("before").isNull() | (F.col("before") == 0), F.coalesce(since_birth, F.lit("T0")))
        .when(F.col("ts") == F.col("before"), F.lit("-"))
        .otherwise(elapsed_text(F.col("ts") - F.col("before")))
    )
    return df.select(*keys, "kind", "ts", "source", "place", gap.alias("gap"), "text")
