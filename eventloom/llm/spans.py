"""Spans of long texts in SQL functions: running totals and pieces of a text in about linear time.

Adding one element to an array copies it, so a fold over n spans costs n * n. Here a list is folded
in runs of about the square root of its length, and the runs' totals are folded once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block of a cut text.
BLOCK_CHARS = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results of a short array."""
    start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, value: Column) -> Column:
        at = F.when(acc["at"].isNull(), value).otherwise(combine(acc["at"], value))
        return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

    return F.aggregate(values, start, step, lambda acc: acc["all"])


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For every element of an int array the combination of all up to it; ``combine`` is associative."""

    def of(held: Column) -> Column:
        n = F.size(held)
        each = F.ceil(F.sqrt(n)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.ceil(n / each).cast("int") - 1), lambda i: _run(F.slice(held, i * each + 1, each), combine))

        def together(inner: Column) -> Column:
            ends = _run(F.transform(inner, lambda r: F.element_at(r, -1)), combine)
            return let(ends, lambda e: F.flatten(F.transform(inner, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda x: combine(F.get(e, i - 1), x))))))

        return F.when(n == 0, held).otherwise(let(runs, together))

    return let(values, of)


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def blocks(text: Column) -> Column:
    """A text cut into blocks of ``BLOCK_CHARS``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text given in blocks: only their blocks are looked at."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    n = F.floor((end - 1) / BLOCK_CHARS).cast("int") - first + 1
    near = F.array_join(F.slice(cut, first + 1, F.greatest(n, F.lit(1))), "")
    return F.when(end > start, F.substring(near, (start - first * BLOCK_CHARS + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))
