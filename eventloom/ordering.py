"""Ordered groups that stay bounded when one key holds a large share of the rows.

A window over ``subject_id`` puts one subject's rows into one task. That is
right for ordinary subjects and wrong for one that holds a third of the table.
``order_groups`` counts rows per key (a map-side combined aggregate over the key
columns alone); keys above the limit are cut into consecutive chunks by Spark's
own range partitioning on the full sort key. Windows then run per (key, chunk)
and a small table of chunk ends carries state from one chunk to the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventloom.session import materialize

MAX_GROUP_ROWS = 1_000_000
LIMIT_KEY = "eventloom.maxGroupRows"
#: Items of a group's array that one row may hold.
MAX_ROW_ITEMS = 50_000_000
ROW_LIMIT_KEY = "eventloom.maxRowItems"


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_KEY, str(MAX_GROUP_ROWS)))


@dataclass(frozen=True)
class Ordered:
    """Rows with a total order per key.

    ``chunk`` is 0 for whole groups and 1, 2, ... for the pieces of a cut one.
    """

    df: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool = False

    @property
    def group(self) -> list[str]:
        return [*self.keys, "chunk"] if self.cut else self.keys

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def sort_key(self) -> Column:
        return F.struct(*self.order)

    def with_df(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df)


def order_groups(
    df: DataFrame, keys: list[str], order: list[str], sized_by: DataFrame | None = None, limit: int | None = None
) -> Ordered:
    """Attach ``chunk``.

    ``sized_by`` may name a cheaper table with about the same rows per key, such
    as the source a derived table was made from: only its key columns are read.
    ``limit`` (by default the session's): rows of a key that stay in one piece.
    """
    limit = limit or group_limit(df)
    sizes = (sized_by if sized_by is not None else df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > limit)
    found = large.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    if found["keys"] == 0:
        return Ordered(df.withColumn("chunk", F.lit(0)), keys, order)
    return _cut(df, keys, order, large.select(*keys), found["rows"], limit)


def _cut(df: DataFrame, keys: list[str], order: list[str], large: DataFrame, rows: int, limit: int) -> Ordered:
    # A range per chunk, unless chunks are so small that ranges of many chunks are cheaper to deal out.
    wanted = math.ceil(rows / limit) + 1
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = min(wanted, max(shuffles, math.ceil(rows / MAX_GROUP_ROWS) + 1))
    # At most (all rows / limit) keys can be large, so this table is small.
    large = materialize(large, "large-groups")
    ranged = (
        df.join(large, keys, "left_semi")
        .repartitionByRange(pieces, *keys, *order)
        .withColumn("piece", F.spark_partition_id())
    )
    # Range bounds come from sampling: fix them by writing the rows once.
    ranged = materialize(ranged, "large-group-rows")
    if pieces < wanted:
        cut = _cut_pieces(ranged, keys, order, limit)
    else:
        first = materialize(ranged.groupBy(*keys).agg(F.min("piece").alias("first_piece")), "first-pieces")
        cut = ranged.join(first, keys).withColumn("chunk", F.col("piece") - F.col("first_piece") + 1)
    whole = df.join(large, keys, "left_anti").withColumn("chunk", F.lit(0))
    return Ordered(whole.unionByName(cut.select(whole.columns)), keys, order, cut=True)


def _cut_pieces(ranged: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Every ``limit`` rows of a key within a range become a ``chunk``; rows that tie stay together."""
    # A window over a key within its range holds no more rows than the range.
    within = Window.partitionBy(*keys, "piece").orderBy(*order)
    parts = ranged.withColumn("_part", F.floor((F.rank().over(within) - 1) / limit).cast("int"))
    # One row per key and range that it touches.
    sizes = ranged.groupBy(*keys, "piece").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_parts"))
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.withColumn("_earlier", F.coalesce(F.sum("_parts").over(before), F.lit(0)).cast("int")).drop("_parts")
    return parts.join(earlier, [*keys, "piece"]).withColumn("chunk", F.col("_earlier") + F.col("_part") + 1)


def reorder(rows: Ordered, df: DataFrame, order: list[str]) -> Ordered:
    """Same rows under another order; cut groups are cut again along it."""
    if not rows.cut:
        return replace(rows, df=df, order=order)
    return order_groups(df.drop("chunk"), rows.keys, order)


def last_before(rows: Ordered, value: Column, name: str) -> Ordered:
    """Last non-null ``value`` strictly before each row."""
    df = rows.df.withColumn("_value", value)
    before = F.last("_value", ignorenulls=True).over(
        rows.window().rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn(name, before)
    if rows.cut:
        ends = df.where("chunk > 0").groupBy(*rows.group).agg(
            F.max_by("_value", F.when(F.col("_value").isNotNull(), rows.sort_key())).alias("_end")
        )
        earlier = Window.partitionBy(*rows.keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        df = _with_carry(rows, df, ends, F.last("_end", ignorenulls=True).over(earlier))
        df = df.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    return rows.with_df(df.drop("_value"))


def next_value(rows: Ordered, value: Column, name: str) -> Ordered:
    """``value`` of the row after each row."""
    df = rows.df.withColumn("_value", value)
    df = df.withColumn(name, F.lead("_value").over(rows.window()))
    if rows.cut:
        df = df.withColumn("_last", F.lead(F.lit(1)).over(rows.window()).isNull())
        starts = df.where("chunk > 0").groupBy(*rows.group).agg(
            F.min_by("_value", rows.sort_key()).alias("_end")
        )
        later = Window.partitionBy(*rows.keys).orderBy("chunk")
        df = _with_carry(rows, df, starts, F.lead("_end").over(later))
        df = df.withColumn(name, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col(name)))
        df = df.drop("_carry", "_last")
    return rows.with_df(df.drop("_value"))


def running_total(rows: Ordered, value: Column, name: str) -> Ordered:
    """Sum of ``value`` up to and including each row."""
    df = rows.df.withColumn("_value", value)
    upto = rows.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(name, F.sum("_value").over(upto))
    if rows.cut:
        totals = df.where("chunk > 0").groupBy(*rows.group).agg(F.sum("_value").alias("_end"))
        earlier = Window.partitionBy(*rows.keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        df = _with_carry(rows, df, totals, F.sum("_end").over(earlier))
        df = df.withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry")
    return rows.with_df(df.drop("_value"))


def _with_carry(rows: Ordered, df: DataFrame, ends: DataFrame, carry: Column) -> DataFrame:
    """Join what each chunk takes over from its neighbours (one row per chunk, so small)."""
    table = materialize(ends, "chunk-ends").withColumn("_carry", carry).drop("_end")
    return df.join(table, rows.group, "left")


def gather(rows: Ordered, *aggregates: Column) -> DataFrame:
    """One row per group (per chunk of a cut group), with ``chunk`` kept."""
    return rows.df.groupBy(*rows.keys, "chunk").agg(*aggregates)


def in_order(rows: Ordered, *fields: Column | str, keep: Column | None = None) -> Column:
    """Aggregate: the fields of a group's rows as an array of structs in order."""
    item = F.struct(rows.sort_key().alias("_key"), F.struct(*fields).alias("item"))
    item = F.when(keep, item) if keep is not None else item
    return F.transform(F.sort_array(F.collect_list(item)), lambda pair: pair["item"])


def whole_groups(rows: Ordered, gathered: DataFrame, *arrays: str) -> DataFrame:
    """One row per group: the arrays of a cut group's chunks end to end.

    Other columns are the same in all chunks of a group; ``chunk`` becomes 0. A group of more
    items than one row should hold is refused before it is put together.
    """
    if not rows.cut:
        return gathered
    gathered = materialize(gathered, "chunk-arrays")
    limit = int(gathered.sparkSession.conf.get(ROW_LIMIT_KEY, str(MAX_ROW_ITEMS)))
    sizes = gathered.groupBy(*rows.keys).agg(F.sum(F.size(arrays[0])).alias("n")).where(F.col("n") > limit)
    widest = sizes.orderBy(F.desc("n")).first()
    if widest is not None:
        name = ", ".join(f"{k} {widest[k]}" for k in rows.keys)
        raise ValueError(
            f"{name} has {widest['n']} items, more than one row holds ({ROW_LIMIT_KEY} = {limit}); "
            "eventloom.sources.sequences stores it in blocks"
        )
    others = [c for c in gathered.columns if c not in (*rows.keys, "chunk", *arrays)]
    parts = F.array_sort(F.collect_list(F.struct("chunk", *arrays))).alias("_parts")
    together = gathered.groupBy(*rows.keys).agg(parts, *[F.any_value(c, True).alias(c) for c in others])
    ends = [F.flatten(F.col("_parts").getField(name)).alias(name) for name in arrays]
    return together.select(*rows.keys, F.lit(0).alias("chunk"), *others, *ends)


def edge_chunks(rows: Ordered) -> DataFrame | None:
    """First and last chunk number of every cut group, or None when there is none."""
    if not rows.cut:
        return None
    numbers = rows.df.where("chunk > 0").groupBy(*rows.keys).agg(
        F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk")
    )
    return materialize(numbers, "edge-chunks")
