"""Operator contract: fit on training events, transform any events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.frames import EventFrame
from eventloom.functions.match import KINDS, code_matches
from eventloom.functions.text import float_or_null, float_text


class Operator:
    """A step over the event table.

    ``fitted`` is a small table learned by ``fit`` (None where nothing is
    learned). ``position`` is the step's place in a chain; it orders the rows
    that inserting steps add.
    """

    inserts = False
    fitted: DataFrame | None = None
    position = 0

    def fit(self, train: DataFrame) -> "Operator":
        return self

    def apply(self, frame: EventFrame) -> EventFrame:
        raise NotImplementedError

    def transform(self, events: DataFrame) -> DataFrame:
        return self.apply(EventFrame(events)).union()

    def fit_transform(self, events: DataFrame) -> DataFrame:
        return self.fit(events).transform(events)

    def save_fit(self, path: str, mode: str = "errorifexists") -> None:
        if self.fitted is not None:
            self.fitted.write.mode(mode).parquet(path)

    def load_fit(self, spark: SparkSession, path: str) -> "Operator":
        self.fitted = spark.read.parquet(path)
        return self

    def inserted_seq(self, index: int = 0) -> Column:
        """Negative, so inserted rows precede source rows; earlier steps come first."""
        return F.lit(-1_000_000_000 + self.position * 1_000 + index).cast("bigint")


class MatchingOperator(Operator):
    def __init__(self, matching_type: str, matching_value: str):
        if matching_type not in KINDS:
            raise ValueError(f"codes cannot be matched by {matching_type!r}")
        self.matching_type = matching_type
        self.matching_value = matching_value

    def matches(self) -> Column:
        return code_matches(self.matching_type, self.matching_value)


class CodeOperator(MatchingOperator):
    """Rewrites the code of matching rows."""

    def rewrite(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError

    def apply(self, frame: EventFrame) -> EventFrame:
        return frame.map(self.rewrite, rewrites_code=True)


def is_text(events: DataFrame, column: str) -> bool:
    return isinstance(events.schema[column].dataType, T.StringType)


def value_text(events: DataFrame, column: str) -> Column:
    return F.col(column) if is_text(events, column) else float_text(F.col(column).cast("double"))


def value_number(events: DataFrame, column: str) -> Column:
    return float_or_null(F.col(column)) if is_text(events, column) else F.col(column).cast("double")


class ValueOperator(MatchingOperator):
    """Turns a value column into text; matching numbers get the operator's label.

    A second value operator on the same column sees the first one's text, so
    ``Q3`` passes through it unchanged.
    """

    def __init__(self, matching_type: str, matching_value: str, value_column: str):
        super().__init__(matching_type, matching_value)
        self.value_column = value_column

    def training_values(self, train: DataFrame) -> DataFrame:
        """(code, value) of the rows this operator learns from."""
        kept = train.where(self.matches() & F.col(self.value_column).isNotNull())
        return kept.select("code", value_number(train, self.value_column).alias("value")).where(
            F.col("value").isNotNull()
        )

    def fit(self, train: DataFrame) -> "ValueOperator":
        return self.fit_values(self.training_values(train))

    def fit_values(self, values: DataFrame) -> "ValueOperator":
        """Learn from (code, value) rows."""
        return self

    def attach(self, events: DataFrame) -> DataFrame:
        """Join what ``label`` needs."""
        return events

    def label(self, number: Column) -> Column:
        raise NotImplementedError

    def encode(self, events: DataFrame) -> DataFrame:
        columns = events.columns
        value = F.col(self.value_column)
        number = value_number(events, self.value_column)
        text = value_text(events, self.value_column)
        numeric_match = self.matches() & number.isNotNull()
        # Of a number column the text is that of the number.
        unlabelled = F.when(numeric_match, float_text(number)).otherwise(text) if is_text(events, self.value_column) else text
        labelled = F.coalesce(F.when(numeric_match, self.label(number)), unlabelled)
        encoded = F.when(value.isNotNull(), labelled)
        return self.attach(events).withColumn(self.value_column, encoded).select(columns)

    def apply(self, frame: EventFrame) -> EventFrame:
        return frame.map(self.encode)
