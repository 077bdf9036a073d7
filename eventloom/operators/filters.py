"""Operators that drop rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.frames import EventFrame
from eventloom.functions.match import raw_test
from eventloom.functions.prefixes import with_first_prefix
from eventloom.operators.base import MatchingOperator, Operator
from eventloom.schema import BIRTH
from eventloom.session import materialize


def as_flag(value: bool | str) -> bool:
    """Options may arrive as text: ``"true"``."""
    return value.strip().lower() == "true" if isinstance(value, str) else bool(value)


class FilterEvents(MatchingOperator):
    """Drop rows whose code matches, or with ``invert`` keep only those.

    Null codes go either way; ``ends_with`` is not a filter and passes all rows.
    """

    def __init__(self, matching_type: str, matching_value: str, invert: bool | str = False):
        super().__init__(matching_type, matching_value)
        self.invert = as_flag(invert)

    def keep(self, events: DataFrame) -> DataFrame:
        if self.matching_type == "ends_with":
            return events
        test = raw_test(self.matching_type, self.matching_value)
        return events.where(test if self.invert else ~test)

    def apply(self, frame: EventFrame) -> EventFrame:
        return frame.map(self.keep)


class PrefixFilters(Operator):
    """Drop rows whose code starts with any of many prefixes, and those without a code, as that many filters do."""

    def __init__(self, prefixes: list[str]):
        self.prefixes = prefixes

    def keep(self, events: DataFrame) -> DataFrame:
        found = with_first_prefix(events, F.col("code"), self.prefixes, "_dropped_by")
        return found.where(F.col("code").isNotNull() & F.col("_dropped_by").isNull()).drop("_dropped_by")

    def apply(self, frame: EventFrame) -> EventFrame:
        return frame.map(self.keep)


class TopKCodes(MatchingOperator):
    """Among codes with a prefix keep the k most frequent of the training events.

    Ties at the cut go to the alphabetically first code.
    """

    IN_LIST_LIMIT = 10_000

    def __init__(self, matching_type: str, matching_value: str, k: int = 100):
        super().__init__(matching_type, matching_value)
        self.k = int(k)

    def fit(self, train: DataFrame) -> "TopKCodes":
        counts = (
            train.where(F.col("code").startswith(self.matching_value))
            .groupBy("code")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return self.fit_counts(counts)

    def fit_counts(self, counts: DataFrame) -> "TopKCodes":
        """Learn from ``code`` and its number ``n`` of training events; codes without the prefix do not matter."""
        counts = counts.where(F.col("code").startswith(self.matching_value))
        top = counts.orderBy(F.desc("n"), "code").limit(self.k).select("code")
        self.fitted = materialize(top, "top-codes")
        return self

    def keep(self, events: DataFrame) -> DataFrame:
        other = ~F.col("code").startswith(self.matching_value)
        if self.k <= self.IN_LIST_LIMIT:
            # k codes at most: a literal list is pushed into the scan, no join needed.
            top = [row["code"] for row in self.fitted.collect()]
            return events.where(other | F.col("code").isin(top))
        flagged = events.join(self.fitted.withColumn("_top", F.lit(True)), "code", "left")
        return flagged.where(other | F.col("_top")).select(events.columns)

    def apply(self, frame: EventFrame) -> EventFrame:
        return frame.map(self.keep)


class DropBirth(Operator):
    def apply(self, frame: EventFrame) -> EventFrame:
        return frame.map(without_birth)


def without_birth(events: DataFrame) -> DataFrame:
    return events.where(F.col("code") != BIRTH)
