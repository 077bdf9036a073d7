"""Running a chain of operators: fitting it, then applying it."""

from __future__ import annotations

import warnings
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.frames import EventFrame
from eventloom.functions.prefixes import BRANCHES
from eventloom.functions.quantiles import exact_quantiles
from eventloom.operators.base import CodeOperator, Operator, value_number
from eventloom.operators.codes import CodeEnrichment
from eventloom.operators.filters import FilterEvents, PrefixFilters
from eventloom.operators.values import PerCodeEdges
from eventloom.session import materialize


def number_operators(operators: list[Operator]) -> list[Operator]:
    for i, operator in enumerate(operators):
        operator.position = i
    return operators


def apply_operators(operators: list[Operator], events: DataFrame) -> DataFrame:
    """Run fitted operators in order.

    Up to the last inserting operator source and inserted rows stay apart; after
    it they are one table, so later operators appear once in the plan.
    """
    frame = EventFrame(events)
    operators = _prefix_filters_together(operators)
    last_insert = max((i for i, op in enumerate(operators) if op.inserts), default=-1)
    for i, operator in enumerate(operators):
        frame = operator.apply(frame)
        if i == last_insert:
            frame = EventFrame(frame.union())
    return frame.union()


def _prefix_filters_together(operators: list[Operator]) -> list[Operator]:
    """Runs of many filters that drop by prefix as one: a plan of thousands of filters does not compile."""
    found: list[Operator] = []
    for by_prefix, run in groupby(operators, lambda op: isinstance(op, FilterEvents) and op.matching_type == "starts_with" and not op.invert):
        run = list(run)
        found += [PrefixFilters([op.matching_value for op in run])] if by_prefix and len(run) > BRANCHES else run
    return found


def fit_operators(operators: list[Operator], train: DataFrame, fit_mode: str = "joint") -> list[Operator]:
    """Fit on training events.

    ``joint``: value operators learn from the raw events with all code rewrites
    applied, in one pass for all of them; other operators learn from the raw
    events. ``prefix``: each learns from the output of those before it.
    """
    number_operators(operators)
    if fit_mode == "prefix":
        for i, operator in enumerate(operators):
            operator.fit(apply_operators(operators[:i], train))
        return operators
    if fit_mode != "joint":
        raise ValueError("fit_mode must be 'joint' or 'prefix'")
    _warn_of_rewritten_codes(operators)
    learners = [op for op in operators if isinstance(op, PerCodeEdges)]
    for operator in operators:
        if operator not in learners:
            operator.fit(train)
    if learners:
        rewritten = apply_operators([op for op in operators if isinstance(op, CodeOperator)], train)
        _fit_together(learners, rewritten)
    return operators


def _fit_together(learners: list[PerCodeEdges], train: DataFrame) -> None:
    """Quantiles of every learner; those that ask for the same ones learn from one table."""
    hits = [
        F.when(
            op.matches() & value_number(train, op.value_column).isNotNull(),
            F.struct(F.lit(i).alias("op"), value_number(train, op.value_column).alias("value")),
        )
        for i, op in enumerate(learners)
    ]
    values = train.select("code", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("code", "hit.*")
    by_probabilities: dict[tuple, list[int]] = {}
    for i, op in enumerate(learners):
        by_probabilities.setdefault(tuple(op.probabilities), []).append(i)
    if len(by_probabilities) > 1:
        values = materialize(values, "training-values")
    fits = [
        exact_quantiles(values.where(F.col("op").isin(ops)), ["op", "code"], "value", list(probabilities))
        for probabilities, ops in by_probabilities.items()
    ]
    edges = materialize(reduce(DataFrame.unionByName, fits), "code-edges")
    for i, op in enumerate(learners):
        op.fitted = edges.where(F.col("op") == i).drop("op")


def _warn_of_rewritten_codes(operators: list[Operator]) -> None:
    enrichments = [i for i, op in enumerate(operators) if isinstance(op, CodeEnrichment)]
    bins = [i for i, op in enumerate(operators) if isinstance(op, PerCodeEdges)]
    if bins and enrichments and min(bins) < max(enrichments):
        warnings.warn(
            "bins are fitted on enriched codes but applied before the enrichment, so enriched codes "
            "stay unbinned; put code_enrichment first or use fit_mode='prefix'",
            stacklevel=3,
        )
