"""Prefix rules as a table against trying one prefix after the other."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import prefixes
from eventloom.operators.filters import FilterEvents
from eventloom.operators.measurements import DemographicAggregation
from eventloom.operators.sequence import DemographicSortOrder, build_sequence
from eventloom.plans import chain

TEXTS = ["LAB//1", "LAB//12//x", "LA", "", None, "MED//é//日", "x", "LAB//12//xy"]


def many(n, seed=1):
    """Prefixes of all lengths, some repeated, among them those of the texts."""
    rng = random.Random(seed)
    own = [t[:k] for t in TEXTS if t for k in range(len(t) + 1)]
    listed = [rng.choice(own) if rng.random() < 0.02 else f"P{rng.randint(0, 10**6)}" * rng.randint(1, 3) for _ in range(n)]
    return [p for p in listed if p]


@pytest.mark.parametrize("n", [3, 90, 5000])
def test_lookups_equal_a_chain(spark, n):
    listed = many(n)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    first = {r.id: r.place for r in prefixes.with_first_prefix(df, F.col("text"), listed, "place").collect()}
    every = sorted((r.id, r.place) for r in prefixes.with_all_prefixes(df, F.col("text"), listed, "place").collect())
    hits = [(i, k) for i, t in enumerate(TEXTS) for k, p in enumerate(listed) if t is not None and t.startswith(p)]
    assert every == hits
    assert first == {i: min((k for j, k in hits if j == i), default=None) for i in range(len(TEXTS))}
    assert "SortMergeJoin" not in prefixes.with_first_prefix(df, F.col("text"), listed, "place")._jdf.queryExecution().executedPlan().toString()


def test_an_empty_prefix_starts_every_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    listed = [f"Q{i}" for i in range(100)] + [""]
    rows = prefixes.with_first_prefix(df, F.col("text"), listed, "place").collect()
    assert all(r.place == (None if r.text is None else 100) for r in rows)


def both(monkeypatch, make):
    """The result with branches, and with tables."""
    branches = make()
    for module in (prefixes, chain):
        monkeypatch.setattr(module, "BRANCHES", 0)
    return branches, make()


def test_operators_give_the_same_with_tables(spark, fixtures, monkeypatch):
    events = fixtures.events()

    def order():
        rows = DemographicSortOrder(["STATIC", "LAB//9", "LAB//", "MEDICAL//", "LAB//1"]).apply(build_sequence(events.withColumn("time", F.when(F.col("seq") % 2 == 0, F.col("time")))))
        return sorted(map(str, rows.df.select("subject_id", "seq", "rank", "rank_code").collect()))

    def filtered():
        ops = [FilterEvents("starts_with", p) for p in ("LAB//9", "DIAG", "BMI")] + [FilterEvents("contains", "drug1")]
        return sorted(map(str, chain.apply_operators(ops, events).select("subject_id", "seq", "code").collect()))

    def values():
        ms = [{"token_pattern": p, "value_column": c, "aggregation": a} for p, c, a in (("LAB//", "numeric_value", "mean"), ("LAB//1", "numeric_value", "max"), ("BMI", "text_value", "median"), ("LAB//", "numeric_value", "min"))]
        return sorted(map(str, DemographicAggregation(ms).subject_values(events).collect()))

    for make in (order, filtered, values):
        branches, tables = both(monkeypatch, make)
        assert branches == tables and branches
        monkeypatch.undo()


def test_five_thousand_rules_compile(spark, fixtures):
    events = fixtures.events()
    listed = [p for p in many(5000, 3) if not p.startswith(("L", "M"))] + ["LAB//9"]
    kept = chain.apply_operators([FilterEvents("starts_with", p) for p in listed], events)
    assert kept.count() == events.where("code is not null and not startswith(code, 'LAB//9')").count()
    rows = DemographicSortOrder(listed).apply(build_sequence(events)).df
    assert rows.where("time is null").agg(F.max("rank")).first()[0] in (None, len(set(listed)), len(listed))
    ms = [{"token_pattern": p, "value_column": "numeric_value", "aggregation": "mean"} for p in listed]
    found = DemographicAggregation(ms).subject_values(events)
    assert found.select("m").distinct().collect()[0]["m"] == len(listed) - 1
