"""Events to subject texts, and events to text ids with real times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.bpe import TextBpe, byte_level_runs
from eventloom.operators.phrases import EventPhrases, patient_text, word_timeline
from eventloom.operators.pieces import encode_list_column
from eventloom.ordering import gather, in_order, whole_groups
from eventloom.sources.events import path_exists
from eventloom.sources.sinks import write_mode, write_translated


def translate_dataset(
    phrases: EventPhrases,
    events: DataFrame,
    path: str,
    overwrite: bool = False,
    skip_existing: bool = False,
) -> None:
    """Write the texts of every subject, one folder per split; ``skip_existing`` leaves out the splits already there."""
    if skip_existing and "split" in events.columns:
        names = [row["split"] for row in events.select("split").distinct().collect()]
        there = [name for name in names if path_exists(events.sparkSession, f"{path}/split={name}")]
        if len(there) == len(names):
            return
        events = events.where(~F.col("split").isin(there)) if there else events
        write_translated(patient_text(phrases.translate(events), events), path, "append")
        return
    texts = patient_text(phrases.translate(events), events)
    write_translated(texts, path, write_mode(overwrite, skip_existing))


def encode_events_as_text(tokenizer: TextBpe, phrased: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Timelines of text ids where every piece has the time of its event."""
    rows = word_timeline(phrased, events)
    ids = encode_list_column(tokenizer.run_encoder(), byte_level_runs(F.col("token")))
    encoded = rows.with_df(rows.df.withColumn("ids", ids))
    grouped = gather(encoded, in_order(encoded, "ids", "ts").alias("items"))
    pieces = grouped.select(
        *rows.keys,
        "chunk",
        F.flatten(F.transform("items", lambda i: i["ids"])).alias("tokens"),
        F.flatten(F.transform("items", lambda i: F.array_repeat(i["ts"], F.size(i["ids"])))).alias("timestamps"),
    )
    return whole_groups(rows, pieces, "tokens", "timestamps")
