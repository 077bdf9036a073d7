"""Writers. ``mode``: ``errorifexists`` (default), ``overwrite`` or ``ignore`` (skip when present)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.layout import write_bucketed

MODES = {"fail": "errorifexists", "overwrite": "overwrite", "skip": "ignore"}


def write_mode(overwrite: bool = False, skip_existing: bool = False) -> str:
    return MODES["overwrite" if overwrite else "skip" if skip_existing else "fail"]


def write_timelines(timelines: DataFrame, path: str, mode: str = "errorifexists", by_subject: bool = False) -> None:
    """Parquet, one folder per split; ``by_subject``: buckets of subjects instead, for joins without an exchange."""
    if by_subject:
        write_bucketed(timelines, path, mode=mode)
        return
    writer = timelines.write.mode(mode)
    (writer.partitionBy("split") if "split" in timelines.columns else writer).parquet(path)


def write_vocab(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file: a vocabulary is at most vocab_size rows."""
    columns = ["token", "str", "count"]
    ordered = vocab.select(columns).coalesce(1).sortWithinPartitions("token")
    ordered.write.mode(mode).csv(path, header=True, escape='"', nullValue="\u0000", emptyValue="",
                                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_narratives(narratives: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, one folder per split."""
    writer = narratives.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy("split") if "split" in narratives.columns else writer).json(path)


def write_translated(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_timelines(texts, path, mode)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small report table as one CSV file; cells keep their blanks."""
    report.coalesce(1).write.mode(mode).csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_shards(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Event shards in one folder per split (``path/train`` ...), ordered by subject and time.

    Ranges of (subject, time, place) are the shards: a subject with a large share of the rows spans several.
    """
    splits = [r["split"] for r in events.select("split").distinct().collect()]
    for split in splits:
        part = events.where(F.col("split") == split).drop("split")
        order = ["subject_id", F.asc_nulls_first("time"), "seq"]
        part.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(f"{path}/{split}")
