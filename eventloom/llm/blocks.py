"""Comparing all members of a group with each other, in blocks of bounded size.

A group's members are dealt into chunks; a pair of chunks is one block, and any
two members of a group meet in exactly one block (or, within a chunk, in the
chunk's own). A group that holds a third of all rows is many blocks over many
tasks, each of at most two chunks. Blocks report sums and the edges of a spanning
forest, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a chunk, about.
CHUNK_ROWS = 1024


def deal(members: DataFrame, key: str, member: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Copies of the members of groups of two and more, one per block: adds ``low``, ``high`` and ``side``.

    ``side`` says whether the row belongs to the block's low chunk (0) or high chunk (1);
    in a chunk's own block all rows have side 0.
    """
    sizes = members.groupBy(key).count().where("count > 1")
    chunks = F.ceil(F.col("count") / F.lit(chunk_rows)).cast("int")
    sized = members.join(sizes.select(key, chunks.alias("_chunks")), key)
    mine = sized.withColumn("_mine", F.pmod(F.xxhash64(F.col(member)), F.col("_chunks")).cast("int"))
    others = mine.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return others.select(
        *members.columns,
        F.least("_mine", "_other").alias("low"),
        F.greatest("_mine", "_other").alias("high"),
        (F.col("_mine") > F.col("_other")).cast("int").alias("side"),
    )


def by_block(dealt: DataFrame, key: str, compare: Callable[[pa.Table, pa.Table | None], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``compare(low rows, high rows)`` on every block; high rows are None in a chunk's own block."""
    placed = dealt.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "low", "high")]
            change = np.zeros(batch.num_rows, bool)
            for mark in marks:
                change[1:] |= mark[1:] != mark[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for begin, end in zip(starts, starts[1:]):
                if end == begin:
                    continue
                block = tuple(mark[begin] for mark in marks)
                if current is not None and block != current:
                    yield from finish(held)
                    held = []
                current = block
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from finish(held)

    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held)
        own = block.column("low")[0].as_py() == block.column("high")[0].as_py()
        side = block.column("side").to_numpy()
        high = int(np.searchsorted(side, 1))
        if own:
            out = compare(block, None) if block.num_rows > 1 else None
        elif 0 < high < block.num_rows:
            out = compare(block.slice(0, high), block.slice(high))
        else:
            out = None
        if out is not None and out.num_rows:
            yield out

    return placed.mapInArrow(run, schema)


def lowest_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the ends of edges (positions ``a``, ``b``): the least label of each component so far."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, np.maximum(la, lb), low)
        # Follow labels to their own label until nothing moves.
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels
