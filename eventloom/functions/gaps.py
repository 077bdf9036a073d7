"""Names of time gaps. All gaps are microseconds."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import fixed_text

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
WEEK = 7 * DAY
YEAR = 31_557_600 * SECOND


def _count_of(number: Column, unit: str) -> Column:
    noun = F.when(number == 1, F.lit(f" {unit}")).otherwise(F.lit(f" {unit}s"))
    return F.concat(number.cast("bigint").cast("string"), noun)


def mimic_gap(gap: Column) -> Column:
    """Minutes, hours, days, then weeks, all rounded down; nothing below five minutes."""
    return (
        F.when(gap < LEAST_GAP["MIMIC"], F.lit(None))
        .when(gap < HOUR, _count_of(F.floor(gap / MINUTE), "minute"))
        .when(gap < DAY, _count_of(F.floor(gap / HOUR), "hour"))
        .when(gap < WEEK, _count_of(F.floor(gap / DAY), "day"))
        .otherwise(_count_of(F.floor(gap / WEEK), "week"))
    )


def cprd_gap(gap: Column) -> Column:
    """Days (at most six), then weeks, rounded half to even; nothing below a day."""
    days = F.least(F.greatest(F.rint(gap / DAY), F.lit(1.0)), F.lit(6.0))
    return (
        F.when(gap < LEAST_GAP["CPRD"], F.lit(None))
        .when(gap < WEEK, _count_of(days, "day"))
        .otherwise(_count_of(F.rint((gap / DAY) / 7.0), "week"))
    )


LADDERS = {"MIMIC": mimic_gap, "CPRD": cprd_gap}
#: The least gap that a ladder names.
LEAST_GAP = {"MIMIC": 5 * MINUTE, "CPRD": DAY}


def cut_ranges(intervals: dict[str, dict]) -> tuple[list[int], list[str | None]]:
    """Configured ranges (minutes, both ends included) cut at their ends into disjoint segments.

    ``starts`` in microseconds, sorted, and the name of each segment: that of the first configured
    range that holds it, None between ranges. A segment ends where the next one starts.
    """
    ranges = []
    for name, limits in intervals.items():
        high = limits.get("max")
        ranges.append((name, int(limits["min"] * MINUTE), None if high is None else int(high * MINUTE)))
    points = sorted({low for _, low, _ in ranges} | {high + 1 for _, _, high in ranges if high is not None})
    # Ranges that have begun and not ended, by their configured place: the least one names the segment.
    begins, ends = defaultdict(list), defaultdict(list)
    for place, (_, low, high) in enumerate(ranges):
        if high is None or high >= low:
            begins[low].append(place)
            if high is not None:
                ends[high + 1].append(place)
    open_: list[int] = []
    closed: set[int] = set()
    names: list[str | None] = []
    for point in points:
        closed.update(ends[point])
        for place in begins[point]:
            heapq.heappush(open_, place)
        while open_ and open_[0] in closed:
            heapq.heappop(open_)
        names.append(ranges[open_[0]][0] if open_ else None)
    return points, names


def _how_many_at_most(starts: list[int], value: Column) -> Column:
    """Number of sorted ``starts`` at or below ``value``, by binary search."""
    listed = F.array(*[F.lit(s).cast("bigint") for s in starts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(starts).bit_length())))])
    return F.aggregate(
        steps, F.lit(0), lambda n, step: F.when(F.get(listed, n + step - 1) <= value, n + step).otherwise(n)
    )


def configured_gap(gap: Column, intervals: dict[str, dict]) -> Column:
    """First configured interval that holds the gap; limits in minutes, both inclusive."""
    starts, names = cut_ranges(intervals)
    if not starts:
        return F.lit(None).cast("string")
    found = _how_many_at_most(starts, gap)
    listed = F.array(*[F.lit(name).cast("string") for name in names])
    return F.when(gap.isNotNull() & (found > 0), F.get(listed, found - 1))


def elapsed_text(seconds: Column) -> Column:
    """``T0``, ``+2.3 years``, ``+45 days`` ... for a difference in seconds.

    A negative difference is shown in whole seconds (``+-90 seconds``), no difference as ``T0``, null as null.
    """
    years = seconds / 31_557_600.0
    days = seconds / 86_400.0
    hours = seconds / 3_600.0
    minutes = seconds / 60.0
    return (
        F.when(seconds == 0, F.lit("T0"))
        .when(years >= 1, F.concat(F.lit("+"), fixed_text(years, 1), F.lit(" years")))
        .when(days >= 1, F.concat(F.lit("+"), fixed_text(days, 0), F.lit(" days")))
        .when(hours >= 1, F.concat(F.lit("+"), fixed_text(hours, 0), F.lit(" hours")))
        .when(minutes >= 1, F.concat(F.lit("+"), fixed_text(minutes, 0), F.lit(" minutes")))
        .otherwise(F.concat(F.lit("+"), fixed_text(seconds, 0), F.lit(" seconds")))
    )
