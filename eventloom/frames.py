"""The event table while a chain of operators runs over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Inserted:
    df: DataFrame
    codes: frozenset[str] | None  # codes these rows may carry; None once they were rewritten


@dataclass(frozen=True)
class EventFrame:
    """Source rows and the rows operators inserted, kept apart until the end.

    Inserted rows are per-subject aggregates of the source rows. Were each
    operator to union them in at once, the next aggregate would scan the union
    again and k operators would cost 2^k scans; kept apart they cost k + 1.
    """

    rows: DataFrame
    inserted: list[Inserted] = field(default_factory=list)

    def map(self, step: Callable[[DataFrame], DataFrame], rewrites_code: bool = False) -> "EventFrame":
        moved = [Inserted(step(part.df), None if rewrites_code else part.codes) for part in self.inserted]
        return EventFrame(step(self.rows), moved)

    def insert(self, df: DataFrame, codes: set[str]) -> "EventFrame":
        """Add rows; columns they lack are null, all take the types of the source rows."""
        return EventFrame(self.rows, [*self.inserted, Inserted(_aligned(df, self.rows), frozenset(codes))])

    def with_code_prefix(self, prefixes: list[str]) -> DataFrame:
        """Source rows plus the inserted rows that could carry one of the prefixes."""
        df = self.rows
        for part in self.inserted:
            if part.codes is None or any(c.startswith(p) for c in part.codes for p in prefixes):
                df = df.unionByName(part.df)
        return df

    def union(self) -> DataFrame:
        df = self.rows
        for part in self.inserted:
            df = df.unionByName(part.df)
        return df


def _aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema
        ]
    )
