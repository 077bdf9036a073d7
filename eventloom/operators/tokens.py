"""Events to strings: the token rows of every subject, and their assembly into sequences."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.ordering import Ordered, edge_chunks, gather, in_order, whole_groups
from eventloom.schema import NO_CODE, epoch_seconds

UNKNOWN, START, END = "<unknown>", "<start>", "<end>"
SPECIAL_TOKENS = [UNKNOWN, START, END]


@dataclass(frozen=True)
class Markers:
    """Which parts of an event are wrapped in marker tokens."""

    event: bool = True
    numeric: bool = True
    text: bool = True

    def tokens(self) -> list[str]:
        shown = []
        for on, name in ((self.event, "event"), (self.numeric, "numeric"), (self.text, "text")):
            shown += [f"<{name}>", f"</{name}>"] if on else []
        return shown


def event_strings(markers: Markers) -> Column:
    """An event's strings in order: code, number, text, unit, with their markers."""
    code = F.when(F.col("code") != NO_CODE, F.col("code"))

    def wrapped(value: str, name: str, on: bool) -> list[Column]:
        if not on:
            return [F.col(value)]
        present = F.col(value).isNotNull()
        return [F.when(present, F.lit(f"<{name}>")), F.col(value), F.when(present, F.lit(f"</{name}>"))]

    strings = [
        code,
        *wrapped("numeric_value", "numeric", markers.numeric),
        *wrapped("text_value", "text", markers.text),
        F.col("unit"),
    ]
    if markers.event:
        strings = [F.lit("<event>"), *strings, F.lit("</event>")]
    return F.array_compact(F.array(*strings))


def token_rows(rows: Ordered, markers: Markers) -> Ordered:
    """One row per token. An event without any keeps one row with a null token: its time still counts."""
    df = rows.df.select(
        *rows.keys,
        "chunk",
        *rows.order,
        F.col("time").isNotNull().alias("timed"),
        epoch_seconds().alias("ts"),
        F.posexplode_outer(event_strings(markers)).alias("part", "token"),
    )
    return replace(rows, df=df, order=[*rows.order, "part"])


def assemble(rows: Ordered, values: Column, start, end, name: str) -> DataFrame:
    """Collect token rows into one sequence per subject; a cut subject's chunks are put together again.

    ``values`` is an array per token row (its ids or its string). ``start`` opens
    the sequence at time 0, ``end`` closes it at the last event's time.
    """
    return whole_groups(rows, assemble_chunks(rows, values, start, end, name), name, "timestamps")


def assemble_chunks(rows: Ordered, values: Column, start, end, name: str) -> DataFrame:
    """The same with one row per chunk of a cut subject: ``chunk`` orders them."""
    prepared = rows.with_df(rows.df.withColumn("_values", values))
    grouped = gather(
        prepared,
        in_order(prepared, "_values", "ts", keep=F.col("token").isNotNull()).alias("_items"),
        F.coalesce(F.max(F.when(F.col("timed"), F.col("ts"))), F.lit(0.0)).alias("_end_ts"),
    )
    edges = edge_chunks(prepared)
    if edges is None:
        grouped = grouped.withColumns({"_first": F.lit(True), "_last": F.lit(True)})
    else:
        whole = F.col("chunk") == 0
        grouped = grouped.join(edges, rows.keys, "left").withColumns(
            {
                "_first": whole | (F.col("chunk") == F.col("first_chunk")),
                "_last": whole | (F.col("chunk") == F.col("last_chunk")),
            }
        )
    body = F.flatten(F.transform("_items", lambda i: i["_values"]))
    times = F.flatten(
        F.transform("_items", lambda i: F.array_repeat(i["ts"], F.size(i["_values"])))
    )
    none = F.slice(F.array(F.lit(start)), 1, 0)
    no_time = F.slice(F.array(F.lit(0.0)), 1, 0)
    tokens = F.concat(
        F.when(F.col("_first"), F.array(F.lit(start))).otherwise(none),
        body,
        F.when(F.col("_last"), F.array(F.lit(end))).otherwise(none),
    )
    stamps = F.concat(
        F.when(F.col("_first"), F.array(F.lit(0.0))).otherwise(no_time),
        times,
        F.when(F.col("_last"), F.array(F.col("_end_ts"))).otherwise(no_time),
    )
    return grouped.select(*rows.keys, "chunk", tokens.alias(name), stamps.alias("timestamps"))


def string_sequences(rows: Ordered) -> DataFrame:
    """``strings`` and ``timestamps`` per subject, from ``<start>`` to ``<end>``."""
    return assemble(rows, F.array("token"), START, END, "strings")
