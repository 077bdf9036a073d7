"""Exact quantiles per key, and bin numbers from their edges.

Keys of at most the session's group limit of values are sorted: repeated values collapse before
the shuffle, and a running count finds the order statistics. For larger keys nothing is sorted.
Every value gets a 64-bit number of the same order. A pass counts the values by the next
``DIGIT_BITS`` leading bits, which are summed before the shuffle, and the bucket that holds a wanted
rank is looked into by the next pass, together with the other wanted ones, until it holds one value:
four passes at most, each with ``2 ** DIGIT_BITS`` counts per wanted rank, however many distinct values a key has.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.ordering import group_limit
from eventloom.session import materialize

#: Leading bits that one pass tells apart.
DIGIT_BITS = 16


def even_probabilities(bins: int) -> list[float]:
    """``bins + 1`` evenly spaced probabilities from 0 to 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def exact_quantiles(
    rows: DataFrame, keys: list[str], value: str, probabilities: list[float], midpoint: bool = False, weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key as an array column ``edges``.

    Null and NaN values do not count. ``midpoint`` averages the two order statistics (a median).
    ``weight`` names a column that says how many values a row stands for.
    """
    number, times = F.col(value).cast("double"), F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    real = rows.where(number.isNotNull() & ~F.isnan(number)).select(F.struct(*keys).alias("_key"), number.alias("_value"), times.alias("_n"))
    sizes = real.groupBy("_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("total"))
    large = sizes.where(F.col("rows") > group_limit(rows)).drop("rows")
    n_large = large.count()
    found = _sorted(real, probabilities) if not n_large else _in_two_ways(real, materialize(large, "large-keys"), probabilities)
    edge = F.struct("i", _between(midpoint).alias("edge"))
    # As many entries per key as there are probabilities.
    sorted_edges = F.sort_array(F.collect_list(edge))
    edges = found.groupBy("_key").agg(F.transform(sorted_edges, lambda e: e["edge"]).alias("edges"))
    return edges.select(*[F.col("_key")[k].alias(k) for k in keys], "edges")


def _asks(probabilities: list[float]) -> Column:
    """Per probability its number ``i``, the ranks ``below`` and ``above`` it, and the share ``t`` between them; ``total`` is a column."""

    def ask(i: int, p: float) -> Column:
        place = (F.col("total") - 1) * F.lit(float(p))
        below = F.floor(place)
        return F.struct(F.lit(i).alias("i"), below.alias("below"), F.least(below + 1, F.col("total") - 1).alias("above"), (place - below).alias("t"))

    return F.array(*[ask(i, p) for i, p in enumerate(probabilities)])


def _sorted(real: DataFrame, probabilities: list[float]) -> DataFrame:
    """Order statistics by a running count over the distinct values of each key."""
    counts = real.groupBy("_key", "_value").agg(F.sum("_n").alias("n"))
    ordered = Window.partitionBy("_key").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("past", F.sum("n").over(ordered)).withColumn("total", F.sum("n").over(Window.partitionBy("_key")))
    first = F.col("past") - F.col("n")

    def holds(rank: Column) -> Column:
        return (rank >= first) & (rank < F.col("past"))

    wanted = F.filter(_asks(probabilities), lambda ask: holds(ask["below"]) | holds(ask["above"]))
    hits = ranked.select("_key", "_value", "n", "past", F.explode(wanted).alias("ask"))
    return hits.groupBy("_key", F.col("ask.i").alias("i")).agg(
        F.max(F.when(holds(F.col("ask.below")), F.col("_value"))).alias("low"),
        F.max(F.when(holds(F.col("ask.above")), F.col("_value"))).alias("high"),
        F.max("ask.t").alias("t"),
    )


def _in_two_ways(real: DataFrame, large: DataFrame, probabilities: list[float]) -> DataFrame:
    # All rows divided by the limit bound the number of large keys.
    few = _sorted(real.join(F.broadcast(large.select("_key")), "_key", "left_anti"), probabilities)
    many = real.join(F.broadcast(large.select("_key")), "_key", "left_semi")
    return few.unionByName(_selected(many, large, probabilities))


def _selected(real: DataFrame, sizes: DataFrame, probabilities: list[float]) -> DataFrame:
    """Order statistics by counts of leading bits."""
    numbered = materialize(real.select("_key", _order_number()(F.col("_value")).alias("number"), "_n"), "order-numbers")
    asks = sizes.select("_key", F.explode(_asks(probabilities)).alias("ask")).select("_key", "ask.*")
    ranks = asks.select("_key", F.explode(F.array("below", "above")).alias("rank")).distinct()
    open_ = materialize(ranks.withColumns({"left": F.col("rank"), "prefix": F.lit(0).cast("long")}), "wanted-ranks")
    closed: list[DataFrame] = []
    for bits in range(DIGIT_BITS, 64 + DIGIT_BITS, DIGIT_BITS):
        buckets = bucket_counts(numbered, open_.select("_key", "prefix").distinct(), bits)
        within = Window.partitionBy("_key", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = buckets.withColumn("past", F.sum("n").over(within))
        hit = (F.col("left") < F.col("past")) & (F.col("left") >= F.col("past") - F.col("n"))
        met = materialize(open_.join(running, ["_key", "prefix"]).where(hit), "wanted-ranks")
        closed.append(met.where("low = high").select("_key", "rank", F.col("low").alias("number")))
        open_ = met.where("low < high").select("_key", "rank", (F.col("left") - F.col("past") + F.col("n")).alias("left"), F.col("digit").alias("prefix"))
        if open_.isEmpty():
            break
    values = reduce(DataFrame.unionByName, closed).select("_key", "rank", _order_value()(F.col("number")).alias("_value"))
    low = values.select("_key", F.col("rank").alias("below"), F.col("_value").alias("low"))
    high = values.select("_key", F.col("rank").alias("above"), F.col("_value").alias("high"))
    return asks.join(low, ["_key", "below"]).join(high, ["_key", "above"]).select("_key", "i", "low", "high", "t")


def bucket_counts(numbered: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """Counts, least and greatest number by the leading ``bits`` (``digit``) within wanted buckets of ``DIGIT_BITS`` bits less."""
    prefix = F.shiftright("number", 64 - bits + DIGIT_BITS) if bits > DIGIT_BITS else F.lit(0).cast("long")
    rows = numbered.select("_key", "number", "_n", prefix.alias("prefix"), F.shiftright("number", 64 - bits).alias("digit"))
    # A few rows per large key.
    inside = rows.join(F.broadcast(wanted), ["_key", "prefix"])
    return inside.groupBy("_key", "prefix", "digit").agg(
        F.sum("_n").alias("n"), F.min("number").alias("low"), F.max("number").alias("high")
    )


def _order_number():
    """The bits of a double as a signed number of the same order; both zeros are one."""

    def number(values: pd.Series) -> pd.Series:
        bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))

    return F.pandas_udf(number, "long")


def _order_value():
    def value(numbers: pd.Series) -> pd.Series:
        bits = numbers.to_numpy(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))

    return F.pandas_udf(value, "double")


def _between(midpoint: bool) -> Column:
    low, high, t = F.col("low"), F.col("high"), F.col("t")
    if midpoint:
        return F.when(t > 0, (low + high) / 2).otherwise(low)
    # The nearer end is the base, so an edge never leaves [low, high].
    return (
        F.when(t == 0, low)
        .when(t >= 0.5, high - (high - low) * (1 - t))
        .otherwise(low + (high - low) * t)
    )


def bin_number(value: Column, edges: Column) -> Column:
    """How many inner edges are at or below the value (0 for the first bin)."""
    inner = F.slice(edges, F.lit(2), F.size(edges) - 2)
    return F.size(F.filter(inner, lambda e: e <= value))
