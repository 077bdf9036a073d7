"""Repeated measurements of a subject as one untimed row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.frames import EventFrame
from eventloom.functions.quantiles import bin_number, even_probabilities, exact_quantiles
from eventloom.functions.prefixes import with_all_prefixes
from eventloom.functions.text import fixed_text
from eventloom.operators.base import Operator, value_number
from eventloom.operators.filters import as_flag
from eventloom.schema import NO_CODE, subject_keys
from eventloom.session import materialize

AGGREGATIONS = ("mean", "min", "max", "median")
VALUE_COLUMNS = ("text_value", "numeric_value")
CHOICES = {"aggregation": AGGREGATIONS, "value_column": VALUE_COLUMNS, "token_pattern": None}


def _problems(i: int, m: dict) -> list[str]:
    """What is wrong with the configuration of one measurement."""
    found = [f"measurement {i} lacks {name!r}" for name in CHOICES if name not in m]
    found += [
        f"measurement {i}: {m[name]!r} is no {name} (known: {', '.join(known)})"
        for name, known in CHOICES.items()
        if known is not None and name in m and m[name] not in known
    ]
    bins, labels = m.get("num_bins"), m.get("bin_labels")
    if bins is not None and bins < 2:
        found.append(f"measurement {i}: {bins} bins cannot tell values apart")
    elif bins is not None and labels is not None and len(labels) != bins:
        found.append(f"measurement {i}: {bins} bins and {len(labels)} labels do not match")
    return found


class DemographicAggregation(Operator):
    """Aggregate values of codes with a prefix per subject, then bin or round them.

    Matching is by prefix, removal of the originals by equality. Bins are
    counted from 1. Edges are fitted on the training subjects' aggregates.
    """

    inserts = True

    def __init__(
        self,
        measurements: list[dict],
        matching_type: str | None = None,
        matching_value: str | None = None,
    ):
        problems = [p for i, m in enumerate(measurements) for p in _problems(i, m)]
        if problems:
            raise ValueError("; ".join(problems))
        self.measurements = measurements
        self.edges: dict[int, list[float]] = {}

    @property
    def patterns(self) -> list[str]:
        return [m["token_pattern"] for m in self.measurements]

    def subject_values(self, events: DataFrame) -> DataFrame:
        """One ``value`` per subject and measurement number ``m``."""
        keys = subject_keys(events)
        numbers = [value_number(events, column).alias(column) for column in VALUE_COLUMNS]
        matched = with_all_prefixes(events.select(*keys, "code", *numbers), F.col("code"), self.patterns, "m")
        of_text = F.array(*[F.lit(m["value_column"] == "text_value") for m in self.measurements])
        value = F.when(F.get(of_text, "m"), F.col("text_value")).otherwise(F.col("numeric_value"))
        values = matched.select(*keys, "m", value.alias("value")).where(F.col("value").isNotNull())
        kinds = [m["aggregation"] for m in self.measurements]
        medians = [i for i, kind in enumerate(kinds) if kind == "median"]
        simple = [i for i, kind in enumerate(kinds) if kind != "median"]
        parts = []
        if simple:
            kind = F.get(F.array(*map(F.lit, kinds)), "m")
            chosen = F.when(kind == "mean", F.col("mean")).when(kind == "min", F.col("min")).otherwise(F.col("max"))
            sums = values.where(F.col("m").isin(simple)).groupBy(*keys, "m").agg(
                _exact_mean("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
            )
            parts.append(sums.select(*keys, "m", chosen.alias("value")))
        if medians:
            middle = exact_quantiles(values.where(F.col("m").isin(medians)), [*keys, "m"], "value", [0.5], midpoint=True)
            parts.append(middle.select(*keys, "m", F.get("edges", F.lit(0)).alias("value")))
        return reduce(DataFrame.unionByName, parts)

    def fit(self, train: DataFrame) -> "DemographicAggregation":
        binned = {i: m["num_bins"] for i, m in enumerate(self.measurements) if "num_bins" in m}
        if not binned:
            return self
        values = materialize(self.subject_values(train).where(F.col("m").isin(list(binned))), "measurement-values")
        fits = [
            exact_quantiles(
                values.where(F.col("m").isin([i for i, b in binned.items() if b == bins])),
                ["m"], "value", even_probabilities(bins),
            )
            for bins in sorted(set(binned.values()))
        ]
        self.fitted = materialize(reduce(DataFrame.unionByName, fits), "measurement-edges")
        return self

    def _edges(self) -> dict[int, list[float]]:
        # One row per configured measurement: literals, not a join.
        return {row["m"]: row["edges"] for row in self.fitted.collect()} if self.fitted is not None else {}

    def label(self) -> Column:
        """Text of an aggregated value; null where bins were asked for but never fitted."""
        edges = self._edges()
        text = F.lit(None).cast("string")
        for i, m in enumerate(self.measurements):
            value = F.col("value")
            if "num_bins" not in m:
                shown = fixed_text(value, m.get("decimals", 1))
            elif i not in edges:
                continue
            else:
                number = bin_number(value, F.array(*[F.lit(e) for e in edges[i]]))
                if m.get("bin_labels") is not None:
                    shown = F.get(F.array(*[F.lit(b) for b in m["bin_labels"]]), number)
                else:
                    shown = F.concat(F.lit("Q"), (number + 1).cast("string"))
            text = F.when(F.col("m") == i, shown).otherwise(text)
        return text

    def _code_and_prefix(self, m: dict) -> tuple[str, str]:
        prefix = m.get("token_prefix", "") or ""
        if as_flag(m.get("insert_code", True)):
            return (prefix.rstrip("/") if prefix else "DEMOGRAPHIC"), ""
        return NO_CODE, prefix

    def apply(self, frame: EventFrame) -> EventFrame:
        events = frame.with_code_prefix(self.patterns)
        keys = subject_keys(events)
        code = prefix = F.lit(None).cast("string")
        seq = F.lit(None).cast("bigint")
        codes = set()
        for i, m in enumerate(self.measurements):
            this = F.col("m") == i
            code_i, prefix_i = self._code_and_prefix(m)
            codes.add(code_i)
            code = F.when(this, F.lit(code_i)).otherwise(code)
            prefix = F.when(this, F.lit(prefix_i)).otherwise(prefix)
            seq = F.when(this, self.inserted_seq(i)).otherwise(seq)
        labelled = self.subject_values(events).withColumn("label", self.label()).where("label is not null")
        added = labelled.select(
            *keys, code.alias("code"), F.concat(prefix, "label").alias("text_value"), seq.alias("seq")
        )
        removed = [m["token_pattern"] for m in self.measurements if as_flag(m.get("remove_original_tokens", False))]
        return frame.map(lambda df: _without_codes(df, removed)).insert(added, codes)


def _exact_mean(value: str) -> Column:
    """Mean whose sum is a decimal: the order of addition, and so the partitioning, cannot change it.

    Groups with a value that no such decimal holds (NaN, infinite, huge) take the floating mean.
    """
    exact = F.col(value).try_cast("decimal(38,9)")
    mean = F.sum(exact).cast("double") / F.count(value)
    return F.when(F.count(exact) == F.count(value), mean).otherwise(F.avg(value))


def _without_codes(events: DataFrame, codes: list[str]) -> DataFrame:
    for code in codes:
        events = events.where(F.col("code") != code)
    return events
