"""Word-level vocabulary: one id per string."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.tokens import SPECIAL_TOKENS, UNKNOWN, assemble
from eventloom.ordering import Ordered
from eventloom.session import materialize

#: Ids whose strings are looked up at once, and so the size of a batch of results.
SLICE_IDS = 1 << 18


def token_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences of every token except the special ones (partial sums before the shuffle)."""
    real = tokens.where(F.col("token").isNotNull() & ~F.col("token").isin(SPECIAL_TOKENS))
    return real.groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(counts: DataFrame, vocab_size: int) -> DataFrame:
    """``token`` id, ``str`` and ``count``: special tokens, then by (count desc, string asc).

    ``<unknown>`` counts the occurrences of everything left out.
    """
    slots = max(vocab_size - len(SPECIAL_TOKENS), 0)
    # The limit keeps the ranking window to vocab_size rows.
    top = counts.orderBy(F.desc("count"), "token").limit(slots)
    ranked = top.select(
        (F.row_number().over(Window.orderBy(F.desc("count"), "token")) + len(SPECIAL_TOKENS) - 1)
        .cast("int")
        .alias("token"),
        F.col("token").alias("str"),
        "count",
    )
    # Total minus kept, as one sum over two one-row tables.
    parts = counts.agg(F.sum("count").alias("n")).unionByName(top.agg((-F.sum("count")).alias("n")))
    left_out = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    specials = [
        F.struct(
            F.lit(i).alias("token"), F.lit(s).alias("str"), (F.col("n") if s == UNKNOWN else F.lit(0)).cast("bigint").alias("count")
        )
        for i, s in enumerate(SPECIAL_TOKENS)
    ]
    first = left_out.select(F.explode(F.array(*specials)).alias("row")).select("row.*")
    return first.unionByName(ranked)


def with_ids(tokens: DataFrame, vocab: DataFrame, vocab_size: int) -> DataFrame:
    """Attach ``id`` to token rows; strings outside the vocabulary get id 0."""
    ids = vocab.select(F.col("token").alias("id"), F.col("str").alias("token"))
    # The vocabulary is a written table, so its true size decides whether it is broadcast.
    return tokens.join(ids, "token", "left").withColumn("id", F.coalesce("id", F.lit(0)))


class WordLevel:
    def __init__(self, vocab_size: int = 1000):
        self.vocab_size = vocab_size
        self.vocab: DataFrame | None = None

    def train(self, rows: Ordered) -> "WordLevel":
        return self.train_counts(token_counts(rows.df))

    def train_counts(self, counts: DataFrame) -> "WordLevel":
        """Learn from ``token`` and ``count``; null and special tokens do not matter."""
        real = counts.where(F.col("token").isNotNull() & ~F.col("token").isin(SPECIAL_TOKENS))
        counts = materialize(real, "token-counts")
        self.vocab = materialize(vocabulary(counts, self.vocab_size), "vocabulary")
        return self

    def encode(self, rows: Ordered) -> DataFrame:
        """Timelines: ``tokens`` and ``timestamps`` per subject."""
        if self.vocab is None:
            raise ValueError("train before encoding")
        known = rows.with_df(self.token_ids(rows.df))
        return assemble(known, F.col("ids"), *self.edge_ids(), "tokens")

    def token_ids(self, tokens: DataFrame) -> DataFrame:
        """Token rows with ``ids``, what each token becomes."""
        return with_ids(tokens, self.vocab, self.vocab_size).withColumn("ids", F.array("id")).drop("id")

    def edge_ids(self) -> tuple[int, int]:
        """Ids that open and close a timeline."""
        return SPECIAL_TOKENS.index("<start>"), SPECIAL_TOKENS.index("<end>")

    def decode(self, timelines: DataFrame) -> DataFrame:
        return decode(timelines, self.vocab)


def _strings(strings: DataFrame, rewrite: Callable[[str], bytes] | None = None):
    """``str`` by ``token``, sent to the executors: at most one row per vocabulary entry."""
    rows = strings.collect()
    table: list[str | bytes | None] = [None] * (max((r["token"] for r in rows), default=-1) + 1)
    for row in rows:
        table[row["token"]] = row["str"] if rewrite is None or row["str"] is None else rewrite(row["str"])
    return strings.sparkSession.sparkContext.broadcast(table)


def _strings_of(ids: np.ndarray, known: pa.Array) -> pa.Array:
    """The string of every id, null for those without."""
    inside = (ids >= 0) & (ids < len(known))
    if not len(known):
        return pa.nulls(len(ids), known.type)
    return known.take(pa.array(np.where(inside, ids, 0), mask=~inside))


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into runs of rows of at most ``SLICE_IDS`` ids (one row at least), with the ids and where each row's begin and end."""
    for batch in batches:
        sizes = np.nan_to_num(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SLICE_IDS, "right")) - 1)
            part = batch.slice(start, stop - start)
            yield part, part.column("tokens").flatten().to_numpy(zero_copy_only=False), bounds[start : stop + 1] - bounds[start]
            start = stop


def _joined(ids: np.ndarray, bounds: np.ndarray, known: pa.Array, behind: pa.Array, strict: bool) -> pa.Array:
    """The strings of each row's ids in one; ``behind`` has the strings behind the separator.

    Strings that are taken lie one after the other, so a row's text is what lies between its bounds.
    """
    missing = ~((ids >= 0) & (ids < len(known)))
    without = known.is_null().to_numpy(zero_copy_only=False)
    if without.any():
        missing[~missing] = without[ids[~missing].astype(np.int64)]
    if missing.any():
        if strict:
            raise ValueError(f"the vocabulary has no entry for id {ids[missing][0]}")
        bounds = np.concatenate([[0], np.cumsum(~missing)])[bounds]
        ids = ids[~missing]
    ids, rows = ids.astype(np.int64), len(bounds) - 1
    if not len(ids):
        return pa.array([""] * rows, known.type)
    first = np.zeros(len(ids), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    both = pa.concat_arrays([known, behind])
    taken = both.take(pa.array(np.where(first, ids, ids + len(known))))
    ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
    return pa.Array.from_buffers(known.type, rows, [None, pa.py_buffer(ends[bounds].tobytes()), taken.buffers()[2]])


def _tables(strings: list[str | bytes | None], separator: str | bytes, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    return pa.array(strings, kind), pa.array([None if s is None else separator + s for s in strings], kind)


def _with_kinds(timelines: DataFrame, more: str) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in timelines.dtypes) + f", {more}"


def with_strings(timelines: DataFrame, strings: DataFrame, separator: str | None = None) -> DataFrame:
    """Add ``strings``: beside each id of ``tokens`` its string, null for ids without one; no shuffle.

    With a ``separator``, ``strings`` is one text: those that are not null, joined by it.
    """
    shared = _strings(strings)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, behind = _tables(shared.value, separator or "", pa.string())
        for batch, ids, bounds in _in_slices(batches):
            if separator is None:
                found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _strings_of(ids, known))
            else:
                found = _joined(ids, bounds, known, behind, strict=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "strings"])

    return timelines.mapInArrow(look_up, _with_kinds(timelines, "strings array<string>" if separator is None else "strings string"))


def spoken(
    timelines: DataFrame, strings: DataFrame, separator: str, strict: bool, as_bytes: Callable[[str], bytes] | None = None
) -> DataFrame:
    """Add ``text``: each timeline's ids looked up inside its array and joined; no shuffle.

    ``strings`` has ``token`` and ``str``, at most one row per vocabulary entry. Ids without a
    string are left out, or fail if ``strict``. With ``as_bytes`` each string stands for bytes and ``text`` is binary.
    """
    shared = _strings(strings, as_bytes)
    kind = pa.string() if as_bytes is None else pa.binary()
    glue = separator if as_bytes is None else separator.encode()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, behind = _tables(shared.value, glue, kind)
        for batch, ids, bounds in _in_slices(batches):
            text = _joined(ids, bounds, known, behind, strict)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])

    return timelines.mapInArrow(look_up, _with_kinds(timelines, "text string" if as_bytes is None else "text binary"))


def decode(timelines: DataFrame, vocab: DataFrame) -> DataFrame:
    """``text``: the strings of a timeline joined by blanks; an id outside the vocabulary fails."""
    return spoken(timelines, vocab.select("token", "str"), " ", strict=True).drop("tokens", "timestamps")


# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
