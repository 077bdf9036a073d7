"""Prefix rules as data: a table joined on a string cut to the lengths that the prefixes have.

A chain of ``when`` branches grows the plan with every rule and no longer compiles for thousands. Here a
rule is a row. Prefixes have few different lengths, and for each of them a string can begin with one
prefix at most, so a lookup is one hash join per length whatever the number of rules.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rules a chain of branches is cheaper than joins.
BRANCHES = 64


def _by_length(prefixes: list[str]) -> dict[int, dict[str, list[int]]]:
    """Places in the list of every prefix, by length."""
    found: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
    for place, prefix in enumerate(prefixes):
        found[len(prefix)][prefix].append(place)
    return dict(sorted(found.items()))


def _cut(text: Column, length: int) -> Column:
    return F.when(F.length(text) >= length, F.substring(text, 1, length)) if length else F.when(text.isNotNull(), F.lit(""))


def _table(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    # As many rows as the configuration has rules: a bound that data cannot move.
    return F.broadcast(spark.createDataFrame(rows, "_prefix string, _place int"))


def with_first_prefix(df: DataFrame, text: Column, prefixes: list[str], name: str) -> DataFrame:
    """Add ``name``: the place of the first listed prefix that ``text`` starts with, null without one."""
    if len(prefixes) <= BRANCHES:
        found = F.lit(None).cast("int")
        for place, prefix in reversed(list(enumerate(prefixes))):
            found = F.when(text.startswith(prefix), F.lit(place)).otherwise(found)
        return df.withColumn(name, found)
    columns, places = df.columns, []
    df = df.withColumn("_text", text)
    for length, listed in _by_length(prefixes).items():
        table = _table(df.sparkSession, [(prefix, min(at)) for prefix, at in listed.items()])
        places.append(f"_place_{length}")
        key = f"_key_{length}"
        named = table.withColumnsRenamed({"_prefix": key, "_place": places[-1]})
        df = df.withColumn(key, _cut(F.col("_text"), length)).join(named, key, "left")
    first = F.least(*places) if len(places) > 1 else F.col(places[0])
    return df.withColumn(name, first).select(*columns, name)


def with_all_prefixes(df: DataFrame, text: Column, prefixes: list[str], name: str) -> DataFrame:
    """One row per listed prefix that ``text`` starts with, its place as ``name``; other rows go."""
    if len(prefixes) <= BRANCHES:
        hits = F.array_compact(F.array(*[F.when(text.startswith(p), F.lit(i)) for i, p in enumerate(prefixes)]))
        return df.withColumn(name, F.explode(hits))
    lengths = _by_length(prefixes)
    cuts = F.array_compact(F.array(*[_cut(text, length) for length in lengths]))
    rows = [(prefix, place) for listed in lengths.values() for prefix, at in listed.items() for place in at]
    table = _table(df.sparkSession, rows).withColumnRenamed("_place", name)
    return df.withColumn("_prefix", F.explode(cuts)).join(table, "_prefix").drop("_prefix")
