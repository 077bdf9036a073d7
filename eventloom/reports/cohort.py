"""Cohort statistics over token timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.quantiles import exact_quantiles
from eventloom.functions.text import fixed_text
from eventloom.session import materialize

# Strings that are not medical events.
SPECIAL_STRINGS = [
    "<unknown>", "<start>", "<end>", "<event>", "</event>", "<numeric>", "</numeric>", "<text>", "</text>",
]

METRICS = {
    "sequence_length": "Sequence Length",
    "num_medical_events": "Unique Medical Events",
    "unique_visits": "Unique Visits",
    "obs_period_years": "Observation Period (years)",
    "mean_time_between_events": "Mean Time Between Events (days)",
}
DAY_SECONDS = 86_400.0


def vocab_special_ids(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("str").isin(SPECIAL_STRINGS)).select("token", "str")


def sequence_metrics(timelines: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row of metrics per subject, measured inside its arrays without a shuffle.

    A written table: the reports aggregate it several times over.
    """
    # At most one id per special string.
    special = [r["token"] for r in vocab_special_ids(vocab).collect()]
    return materialize(_metrics_of_arrays(timelines, special), "cohort-metrics")


def _keys(timelines: DataFrame) -> list[str]:
    return [c for c in timelines.columns if c not in ("tokens", "timestamps", "chunk")]


def _metrics_of_arrays(timelines: DataFrame, special: list[int]) -> DataFrame:
    df = timelines.withColumn("real", F.filter("timestamps", lambda t: t > 0))
    df = df.withColumn(
        "gaps",
        F.zip_with(
            F.slice("real", F.lit(2), F.greatest(F.size("real") - 1, F.lit(0))),
            F.slice("real", F.lit(1), F.greatest(F.size("real") - 1, F.lit(0))),
            lambda later, earlier: (later - earlier) / DAY_SECONDS,
        ),
    )
    n = F.size("gaps")
    gaps = F.sort_array("gaps")
    middle = (F.get(gaps, F.floor((n - 1) / 2).cast("int")) + F.get(gaps, F.floor(n / 2).cast("int"))) / 2
    spread = F.get("real", F.size("real") - 1) - F.get("real", F.lit(0))
    medical = F.filter("tokens", lambda t: ~t.isin(special)) if special else F.col("tokens")
    return df.select(
        *_keys(timelines),
        F.size("tokens").cast("bigint").alias("sequence_length"),
        F.size(F.array_distinct(medical)).cast("bigint").alias("num_medical_events"),
        F.size(F.array_distinct("timestamps")).cast("bigint").alias("unique_visits"),
        _whole_days(F.array_max("real"), F.array_min("real")).alias("obs_period_days"),
        F.when(n > 0, spread / DAY_SECONDS / n).otherwise(0.0).alias("mean_time_between_events"),
        F.when(n > 0, middle).otherwise(0.0).alias("median_time_between_events"),
    )


def _whole_days(latest: Column, earliest: Column) -> Column:
    micros = F.round(latest * 1e6).cast("bigint") - F.round(earliest * 1e6).cast("bigint")
    return F.coalesce(F.floor(micros / 86_400_000_000), F.lit(0)).cast("bigint")


def cohort_table(metrics: DataFrame, attributes: DataFrame) -> DataFrame:
    """Metrics with subject attributes, status and years of observation."""
    status = F.when(F.col("is_case") == 0, F.lit("Control")).when(F.col("is_case") == 1, F.lit("Cancer"))
    return metrics.join(attributes, "subject_id", "left").withColumns(
        {"cancer_status": status, "obs_period_years": F.col("obs_period_days") / 365.25}
    )


def long_metrics(cohort: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """(metric, value) rows, so that all metrics share one aggregation."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return cohort.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def describe(cohort: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Count, mean, spread and quartiles of each metric, optionally by columns."""
    rows = long_metrics(cohort, metrics, *by)
    for column in by:
        rows = rows.where(F.col(column).isNotNull())
    keys = [*by, "metric"]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"),
    )
    quartiles = exact_quantiles(rows, keys, "value", [0.25, 0.5, 0.75])
    named = quartiles.select(
        *keys, *[F.get("edges", F.lit(i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    )
    return sums.join(named, keys)


def value_counts_pct(cohort: DataFrame, column: str, of: Column | None = None) -> DataFrame:
    """Subjects per value and percent of all subjects (of those where ``of`` holds)."""
    rows = cohort if of is None else cohort.where(of)
    share = F.round(F.col("subjects") / F.col("total") * 100, 2)
    counted = _counts_with_total(rows, column).select(
        F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"), "subjects", share.alias("percent")
    )
    return counted.where("value is not null")


def _counts_with_total(rows: DataFrame, column: str) -> DataFrame:
    """Subjects per value beside the total; the window sees one row per distinct value.

    The null group belongs to the total.
    """
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("subjects"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("total", F.sum("subjects").over(everything))


def crosstab_margins(cohort: DataFrame, column: str) -> DataFrame:
    """Category by case status with totals."""
    known = cohort.where(F.col(column).isNotNull() & F.col("is_case").isNotNull())
    counts = known.rollup(column).agg(
        F.count_if(F.col("is_case") == 0).alias("control"),
        F.count_if(F.col("is_case") == 1).alias("cancer"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.select(F.coalesce(F.col(column).cast("string"), F.lit("All")).alias("category"), "control", "cancer", "total")


def few_visits_share(cohort: DataFrame, limit: int = 5) -> DataFrame:
    """Subjects below ``limit`` visits, for all and by status."""
    groups = F.array(F.lit("All"), F.col("cancer_status"))
    rows = cohort.select(F.explode(F.array_compact(groups)).alias("status"), "unique_visits")
    few = F.count_if(F.col("unique_visits") < limit)
    n = F.count(F.lit(1))
    return rows.groupBy("status").agg(n.alias("n"), few.alias("few"), F.round(few / n * 100, 2).alias("percent"))


def gap_stats_positive(cohort: DataFrame) -> DataFrame:
    """Mean of the positive mean and median gaps, for all and by status."""
    groups = F.array_compact(F.array(F.lit("All"), F.col("cancer_status")))
    metrics = ["mean_time_between_events", "median_time_between_events"]
    rows = long_metrics(cohort.withColumn("status", F.explode(groups)), metrics, "status").where("value > 0")
    return rows.groupBy("status", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def histogram_equal_width(cohort: DataFrame, metrics: list[str], bins: int = 50) -> DataFrame:
    """Counts in equal bins between a metric's least and greatest value; the last bin is closed."""
    rows = long_metrics(cohort, metrics).where(F.col("value").isNotNull())
    limits = rows.groupBy("metric").agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
    flat = F.col("least") == F.col("greatest")
    limits = limits.select(
        "metric",
        F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("low"),
        F.when(flat, F.col("greatest") + 0.5).otherwise(F.col("greatest")).alias("high"),
    )
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    step = (high - low) / bins

    def edge(i: Column) -> Column:
        return low + i * step

    guess = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    # The division may land one bin off; the edges decide.
    fixed = F.when(v < edge(guess), guess - 1).when((v >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    # Repeated values collapse before they meet the limits (one row per metric).
    repeated = rows.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = repeated.join(limits, "metric").withColumn("bin", fixed.cast("int"))
    counts = filled.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    every = limits.select("metric", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["metric", "bin"], "left").select(
        "metric", "bin", edge(F.col("bin")).alias("low_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def case_control_comparison(cohort: DataFrame) -> DataFrame:
    """Mean and median of five metrics side by side, as text with two decimals."""
    stats = describe(cohort, list(METRICS), "cancer_status")
    cells = []
    for status in ("Control", "Cancer"):
        for stat in ("mean", "median"):
            value = F.max(F.when(F.col("cancer_status") == status, F.col(stat)))
            cells.append(F.coalesce(fixed_text(value, 2), F.lit("nan")).alias(f"{status.lower()}_{stat}"))
    titles = F.lit(None).cast("string")
    for name, title in METRICS.items():
        titles = F.when(F.col("metric") == name, F.lit(title)).otherwise(titles)
    return stats.groupBy(titles.alias("metric")).agg(*cells)


def summary_table(cohort: DataFrame) -> DataFrame:
    """``metric`` and ``value`` rows of the cohort summary."""
    n = F.count(F.lit(1))
    all_metrics = [*METRICS, "obs_period_days"]
    stats = describe(cohort, all_metrics).groupBy().agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}")
            for m in all_metrics
            for s in ("mean", "median", "std")
        ],
    )
    counts = cohort.agg(
        n.alias("total"),
        F.count_if(F.col("is_case") == 0).alias("control"),
        F.count_if(F.col("is_case") == 1).alias("cancer"),
        F.count_if(F.col("unique_visits") < 5).alias("few"),
    )

    def share(name: str) -> Column:
        return F.concat(
            F.col(name).cast("string"), F.lit(" ("), fixed_text(F.col(name) / F.col("total") * 100, 1), F.lit("%)")
        )

    def number(name: str, decimals: int) -> Column:
        return fixed_text(F.col(name), decimals)

    def plus_minus(metric: str) -> Column:
        return F.concat(number(f"{metric}_mean", 1), F.lit(" ± "), number(f"{metric}_std", 1))

    def years(stat: str) -> Column:
        return F.concat(
            number(f"obs_period_years_{stat}", 2), F.lit(" years ("), number(f"obs_period_days_{stat}", 0), F.lit(" days)")
        )

    def rows(df: DataFrame, cells: list[tuple[str, Column]]) -> DataFrame:
        made = [F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in cells]
        return df.select(F.explode(F.array(*made)).alias("cell")).select("cell.*")

    head = rows(
        counts,
        [
            ("Total Patients", F.col("total").cast("string")),
            ("Control Patients", share("control")),
            ("Cancer Patients", share("cancer")),
            ("Patients with < 5 Visits", share("few")),
        ],
    )
    body = rows(
        stats,
        [
            ("Average Sequence Length", plus_minus("sequence_length")),
            ("Median Sequence Length", number("sequence_length_median", 1)),
            ("Average Unique Medical Events", plus_minus("num_medical_events")),
            ("Average Unique Visits", plus_minus("unique_visits")),
            ("Average Observation Period", years("mean")),
            ("Median Observation Period", years("median")),
            ("Mean Time Between Events", F.concat(number("mean_time_between_events_mean", 2), F.lit(" days"))),
        ],
    )
    by_site = _counts_with_total(cohort.where("is_case = 1"), "site").where("site is not null").select(
        F.concat(F.lit("  - "), "site").alias("metric"), share("subjects").alias("value")
    )
    return head.unionByName(body).unionByName(by_site)
