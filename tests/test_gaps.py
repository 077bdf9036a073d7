"""Configured gap ranges cut into segments against trying one range after the other."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions.gaps import MINUTE, configured_gap, cut_ranges
from eventloom.operators.sequence import TimeIntervals


def first_holding(gap, intervals):
    for name, limits in intervals.items():
        if gap >= int(limits["min"] * MINUTE) and (limits.get("max") is None or gap <= int(limits["max"] * MINUTE)):
            return name
    return None


def random_intervals(n, seed):
    rng = random.Random(seed)
    found = {}
    for i in range(n):
        low = rng.choice([rng.randint(0, 5000), rng.randint(0, 400) / 8])
        found[f"r{i}"] = {"min": low, "max": rng.choice([None, low, low + rng.randint(0, 300), low - 1] if n < 50 else [low, low + rng.randint(0, 60)])}
    return found


@pytest.mark.parametrize("n", [1, 2, 7, 40, 1000])
def test_segments_equal_the_chain(spark, n):
    intervals = random_intervals(n, n)
    starts, names = cut_ranges(intervals)
    assert starts == sorted(set(starts)) and len(names) == len(starts) <= 2 * n
    ends = [int(x * MINUTE) for limits in intervals.values() for x in (limits["min"], limits["max"]) if x is not None]
    gaps = sorted({g + d for g in random.Random(n).sample(ends, min(len(ends), 150)) for d in (-1, 0, 1)} | {0, 10**13})
    df = spark.createDataFrame([(g,) for g in [*gaps, None]], "gap bigint")
    got = {r.gap: r.name for r in df.select("gap", configured_gap(F.col("gap"), intervals).alias("name")).collect()}
    assert got == {**{g: first_holding(g, intervals) for g in gaps}, None: None}
    named = TimeIntervals(intervals).named()
    assert all(named(g) == (got[g] is not None) for g in gaps)


def test_closed_ends_and_the_first_of_two(spark):
    intervals = {"5m-15m": {"min": 5, "max": 15}, "15m-1h": {"min": 15, "max": 60}, "1h-": {"min": 60}}
    gaps = {299_999_999: None, 5 * MINUTE: "5m-15m", 15 * MINUTE: "5m-15m", 15 * MINUTE + 1: "15m-1h", 60 * MINUTE: "15m-1h", 61 * MINUTE: "1h-"}
    df = spark.createDataFrame([(g,) for g in gaps], "gap bigint").select("gap", configured_gap(F.col("gap"), intervals).alias("name"))
    assert {r.gap: r.name for r in df.collect()} == gaps
