"""Code predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.schema import BIRTH, NO_CODE

KINDS = ("starts_with", "ends_with", "contains", "equals", "regex")


def raw_test(kind: str, value: str, column: str | Column = "code") -> Column:
    """The bare comparison; null for a null code."""
    code = F.col(column) if isinstance(column, str) else column
    if kind == "starts_with":
        return code.startswith(value)
    if kind == "ends_with":
        return code.endswith(value)
    if kind == "contains":
        return code.contains(value)
    if kind == "equals":
        return code == value
    if kind == "regex":
        return code.rlike(value)
    raise ValueError(f"unknown matching type {kind!r}; expected one of {KINDS}")


def code_matches(kind: str, value: str, column: str | Column = "code") -> Column:
    """True or false; a null or empty code never matches."""
    code = F.col(column) if isinstance(column, str) else column
    return F.coalesce(raw_test(kind, value, code) & (code != ""), F.lit(False))


def is_real_event(excluded_prefixes: tuple[str, ...]) -> Column:
    """A timed medical event: neither birth, placeholder nor under a demographic prefix."""
    code = F.col("code")
    test = F.col("time").isNotNull() & (code != BIRTH) & (code != NO_CODE)
    for prefix in excluded_prefixes:
        test = test & ~code.startswith(prefix)
    return F.coalesce(test, F.lit(False))
