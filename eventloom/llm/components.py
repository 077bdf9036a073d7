"""Connected components of a graph of links, as joins and aggregations.

Each round every node picks, among itself and its neighbours, the one with the
least hash of that round; links then join the picks. The nodes left shrink by a
constant share per round, so the rounds grow with the logarithm of the longest
path. Picks and links of a round are written tables: no lineage grows, and
nothing but one row (is anything left?) comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import write_once


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of long ids, loops and repeats allowed: every node on an edge with the ``root`` of its component."""
    left = write_once(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    round_number = 0
    while roots is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_number)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        picks = write_once(best.select("node", F.least(F.col("near"), rank("node"))["id"].alias("pick")), "picks")
        to_a = picks.select(F.col("node").alias("a"), F.col("pick").alias("pa"))
        to_b = picks.select(F.col("node").alias("b"), F.col("pick").alias("pb"))
        met = left.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        left = write_once(met.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if roots is None:
            roots = picks.select("node", F.col("pick").alias("root"))
        else:
            step = picks.select(F.col("node").alias("root"), "pick")
            roots = write_once(roots.join(step, "root", "left").select("node", F.coalesce("pick", "root").alias("root")), "roots")
        round_number += 1
    return roots
