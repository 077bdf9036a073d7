"""Operators that turn values into labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.quantiles import bin_number, even_probabilities, exact_quantiles
from eventloom.functions.text import fixed_text
from eventloom.operators.base import ValueOperator
from eventloom.session import materialize


class PerCodeEdges(ValueOperator):
    """Labels from quantile edges fitted per code; unseen codes keep their value."""

    probabilities: list[float]

    def fit_values(self, values: DataFrame) -> "ValueOperator":
        edges = exact_quantiles(values, ["code"], "value", self.probabilities)
        self.fitted = materialize(edges, "code-edges")
        return self

    def attach(self, events: DataFrame) -> DataFrame:
        # A null or unmatched code simply finds no edges; the table's true size
        # is known, so Catalyst broadcasts it only while it is small.
        return events.join(self.fitted.withColumnRenamed("edges", "_edges"), "code", "left")


class QuantileBin(PerCodeEdges):
    """``Q0`` .. ``Q{k-1}``: equal-frequency bins per code."""

    def __init__(self, matching_type: str, matching_value: str, k: int, value_column: str):
        super().__init__(matching_type, matching_value, value_column)
        if k <= 1:
            raise ValueError("k must be greater than 1")
        self.k = k
        self.probabilities = even_probabilities(k)

    def label(self, number: Column) -> Column:
        found = bin_number(number, F.col("_edges")).cast("string")
        return F.when(F.col("_edges").isNotNull(), F.concat(F.lit("Q"), found))


class QuantileBin3Level(PerCodeEdges):
    """``low`` below the first quartile, ``high`` above the third, else ``normal``."""

    probabilities = [0.25, 0.5, 0.75]

    def label(self, number: Column) -> Column:
        first, third = F.get("_edges", F.lit(0)), F.get("_edges", F.lit(2))
        return (
            F.when(F.col("_edges").isNull(), F.lit(None))
            .when(number < first, F.lit("low"))
            .when(number <= third, F.lit("normal"))
            .otherwise(F.lit("high"))
        )


class RoundNumeric(ValueOperator):
    """A fixed number of decimals, rounded on the exact binary value."""

    def __init__(self, matching_type: str, matching_value: str, value_column: str, decimals: int = 1):
        super().__init__(matching_type, matching_value, value_column)
        self.decimals = decimals

    def fit(self, train: DataFrame) -> "RoundNumeric":
        return self

    def label(self, number: Column) -> Column:
        return fixed_text(number, self.decimals)
