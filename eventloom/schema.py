"""The event table: one row per subject, time, code and value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIRTH = "MEDS_BIRTH"
NO_CODE = "STATIC_DATA_NO_CODE"

EVENT_TYPES = {
    "subject_id": T.LongType(),
    "time": T.TimestampType(),
    "code": T.StringType(),
    "numeric_value": T.DoubleType(),
    "text_value": T.StringType(),
    "unit": T.StringType(),
}

SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):/+"

# Sorts before every real timestamp; stands for "no time".
NO_TIME = -(2**63)


def event_table(df: DataFrame) -> DataFrame:
    """Bring a raw table to the event schema; extra columns are kept.

    ``seq`` is the source order that breaks ties between events of one instant.
    Where the input has none it is taken from the row's place in its Parquet
    file, with the file as the high bits.
    """
    if "seq" not in df.columns:
        df = _with_source_order(df)
    columns = {}
    for name, kind in EVENT_TYPES.items():
        if name not in df.columns:
            columns[name] = F.lit(None).cast(kind)
        elif name == "numeric_value" and df.schema[name].dataType == T.StringType():
            continue  # already turned into text by a value operator
        else:
            columns[name] = F.col(name).cast(kind)
    return df.withColumns({**columns, "seq": F.col("seq").cast("bigint")})


def _with_source_order(df: DataFrame) -> DataFrame:
    """``seq`` from the rank of the file among the sorted paths and the row's place in it.

    The ranks are a table of as many rows as the scan lists files, whose size decides how it is joined. A stream has no
    list of its files; there a subject's events of one file are ordered only.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if df.isStreaming:
        return df.withColumn("seq", row)
    # Paths are listed as ``file:///a`` and shown as ``file:/a``.
    listed = sorted(re.sub(SCHEME, r"\1:/", name) for name in df.inputFiles())
    ranks = df.sparkSession.createDataFrame(list(enumerate(listed)), "_rank bigint, _file string")
    shown = F.regexp_replace(path, SCHEME, "$1:/")
    placed = df.withColumns({"_file": shown, "_row": row}).join(ranks, "_file", "left")
    # Every row's file is listed; a file that is not would have its rows fail here rather than tie.
    rank = F.when(F.col("_rank").isNull(), F.raise_error(F.concat(F.lit("unlisted file "), "_file")).cast("bigint")).otherwise(F.col("_rank"))
    return placed.withColumn("seq", F.shiftleft(rank, 40) + F.col("_row")).drop("_file", "_row", "_rank")


def subject_keys(df: DataFrame) -> list[str]:
    """Columns that identify one subject's timeline."""
    return ["subject_id", "split"] if "split" in df.columns else ["subject_id"]


def epoch_us(column: str | Column = "time") -> Column:
    """Microseconds since the epoch, ``NO_TIME`` for untimed rows (they sort first)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.unix_micros(column), F.lit(NO_TIME))


def epoch_seconds(column: str | Column = "time") -> Column:
    """Token timestamp: seconds since the epoch in UTC, 0 for untimed rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.unix_micros(column) / F.lit(1e6), F.lit(0.0))
