"""Narratives, cohort statistics, reconciliation, subject views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.events import ME
from catalog.fixtures import with_views
from catalog.registry import ORACLES, query, stage_path
from catalog.sequences import TOKEN_ORDER, standard_tokens
from catalog.vocabularies import VOCAB, VOCAB_SIZE, train_tokens, trained
from eventloom.operators.word_vocab import WordLevel
from eventloom.reports import cohort, narratives, subjects
from eventloom.session import materialize
from eventloom.sources import events as readers
from eventloom.sources import sinks
from eventloom.sources.layout import read_bucketed, write_bucketed

LABELLED = (ME, "subject_labels", "static_subjects")


def encoded(f):
    """Timelines of the standard chain, written once, and their vocabulary."""
    tokenizer, rows = trained(f)
    return materialize(tokenizer.encode(rows), "timelines"), tokenizer.vocab


LONG = {
    **VOCAB,
    "ids": f"""SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY {TOKEN_ORDER}) AS pos,
      coalesce(v.token, 0) AS token, coalesce(t, 0) AS ts_us FROM toks LEFT JOIN vocab v ON toks.token = v.str""",
    "ends": "SELECT subject_id, coalesce(max(t), 0) AS last_t FROM ev GROUP BY subject_id",
    "line": """SELECT subject_id, pos, token, ts_us FROM ids
      UNION ALL SELECT subject_id, 0, 1, 0 FROM ends
      UNION ALL SELECT subject_id, 1000000000, 2, last_t FROM ends""",
}


# ---- token timelines


@query(
    "timelines_source",
    with_views("SELECT subject_id, count(*) AS tokens FROM line GROUP BY subject_id", ME, **LONG),
)
def timelines_source(f):
    path = stage_path(f, "timelines")
    sinks.write_timelines(encoded(f)[0], path)
    return readers.read_timelines(f.spark, path).select("subject_id", F.size("tokens").cast("bigint").alias("tokens"))


@query(
    "timelines_sink",
    with_views("SELECT split, count(*) AS subjects FROM (SELECT DISTINCT subject_id, split FROM ev) GROUP BY split", ME, **LONG),
)
def timelines_sink(f):
    path = stage_path(f, "timelines")
    sinks.write_timelines(encoded(f)[0], path)
    return f.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("subjects"))


@query("vocab_sink", with_views("SELECT token, str, CAST(count AS BIGINT) AS count FROM vocab", ME, **VOCAB))
def vocab_sink(f):
    path = stage_path(f, "vocab")
    sinks.write_vocab(trained(f)[0].vocab, path)
    return readers.read_vocab(f.spark, path)


@query(
    "vocab_special_ids",
    with_views("SELECT token, str FROM vocab WHERE str IN ('<unknown>', '<start>', '<end>', '<event>')", ME, **VOCAB),
)
def vocab_special_ids(f):
    return cohort.vocab_special_ids(trained(f)[0].vocab)


# ---- narratives

TITLE = """array_to_string(list_transform(regexp_extract_all(replace(raw, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'),
  lambda w: upper(w[1]) || lower(w[2:])), '')"""
SAID = {
    "terms": """SELECT 'M' || upper(code) AS key, arg_max(term, file_order) AS term FROM medical_terms GROUP BY 1
      UNION ALL SELECT 'L' || upper(code), arg_max(term, file_order) FROM lab_terms GROUP BY 1""",
    "raws": "SELECT token, str, upper(string_split(str, '//')[2]) AS raw FROM vocab",
    "phrases": f"""SELECT token, str, CASE
      WHEN starts_with(str, '<time_interval_') THEN trim(string_split(str, '_')[-1], '>')
      WHEN starts_with(str, 'AGE_') THEN str
      WHEN starts_with(str, 'MEDICAL//') THEN coalesce(term, {TITLE})
      WHEN starts_with(str, 'LAB//') THEN 'Lab ' || coalesce(term, {TITLE})
      WHEN regexp_full_match(str, 'Q[0-9]{{1,3}}') THEN str[2:]
      WHEN str IN ('<start>', '<end>', '<unknown>', 'MEDS_BIRTH') THEN '' ELSE 'Unknown' END AS phrase
      FROM raws LEFT JOIN terms ON key = CASE WHEN starts_with(str, 'LAB//') THEN 'L' WHEN starts_with(str, 'MEDICAL//') THEN 'M' END || raw""",
    "texts": """SELECT subject_id, coalesce(string_agg(phrase, ', ' ORDER BY pos) FILTER (phrase <> ''), '') AS text
      FROM line LEFT JOIN phrases USING (token) GROUP BY subject_id""",
}
TERMS = (ME, "medical_terms", "lab_terms")


def phrases(f, vocab):
    return narratives.narrative_phrases(vocab, f.view("medical_terms"), f.view("lab_terms"))


@query("narrative_phrase", with_views("SELECT token, str, phrase FROM phrases", *TERMS, **LONG, **SAID))
def narrative_phrase(f):
    return phrases(f, trained(f)[0].vocab)


@query("narrative_text", with_views("SELECT subject_id, text FROM texts", *TERMS, **LONG, **SAID))
def narrative_text(f):
    timelines, vocab = encoded(f)
    return narratives.narrative_text(timelines, phrases(f, vocab)).select("subject_id", "text")


LABEL_SQL = {
    "statuses": "SELECT *, CASE WHEN is_case = 0 THEN 'Control' ELSE site END AS name FROM subject_labels",
    "numbered": "SELECT name, dense_rank() OVER (ORDER BY name) AS n FROM (SELECT DISTINCT name FROM statuses WHERE name <> 'Control')",
    "labelled": """SELECT subject_id, CAST(CASE WHEN statuses.name = 'Control' THEN 0 ELSE n END AS BIGINT) AS label,
      strftime(TRY_CAST(cancerdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS cancer_date FROM statuses LEFT JOIN numbered USING (name)""",
}


@query("narrative_labels", with_views("SELECT subject_id, label, cancer_date FROM labelled", "subject_labels", **LABEL_SQL))
def narrative_labels(f):
    found = narratives.narrative_labels(f.view("subject_labels"))
    iso = F.date_format("cancer_date", "yyyy-MM-dd'T'HH:mm:ss").alias("cancer_date")
    return found.select("subject_id", F.col("label").cast("bigint").alias("label"), iso)


NARRATIVE_SQL = """SELECT l.subject_id, text, label, cancer_date,
  (SELECT string_agg(CAST(ts_us AS VARCHAR), '|' ORDER BY pos) FROM line WHERE line.subject_id = l.subject_id) AS timestamps
FROM labelled l JOIN texts USING (subject_id)"""


def _narratives(f):
    timelines, vocab = encoded(f)
    return narratives.narrative_dataset(timelines, phrases(f, vocab), f.view("subject_labels"))


def _shown_narratives(df):
    times = F.transform("timestamps", lambda t: F.round(t * 1e6).cast("bigint").cast("string"))
    return df.select(
        "subject_id",
        "text",
        F.col("label").cast("bigint").alias("label"),
        "cancer_date",
        F.array_join(times, "|").alias("timestamps"),
    )


@query(
    "narrative_dataset", with_views(NARRATIVE_SQL, *TERMS, "subject_labels", **LONG, **SAID, **LABEL_SQL)
)
def narrative_dataset(f):
    return _shown_narratives(_narratives(f))


@query("narrative_sink", with_views(NARRATIVE_SQL, *TERMS, "subject_labels", **LONG, **SAID, **LABEL_SQL))
def narrative_sink(f):
    path = stage_path(f, "narratives")
    narratives_ = _narratives(f)
    sinks.write_narratives(narratives_, path)
    return _shown_narratives(f.spark.read.schema(narratives_.schema).json(path))


# ---- cohort statistics

COHORT_SQL = {
    **LONG,
    "gaps": """SELECT subject_id, (ts_us - lag(ts_us) OVER (PARTITION BY subject_id ORDER BY pos)) / 1e6 / 86400.0 AS gap
      FROM line WHERE ts_us > 0""",
    "gap_stats": "SELECT subject_id, avg(gap) AS mean_gap, median(gap) AS median_gap FROM gaps WHERE gap IS NOT NULL GROUP BY subject_id",
    "metrics": """SELECT subject_id, count(*) AS sequence_length, count(DISTINCT token) FILTER (token > 2) AS num_medical_events,
      count(DISTINCT ts_us) AS unique_visits,
      coalesce((max(ts_us) FILTER (ts_us > 0) - min(ts_us) FILTER (ts_us > 0)) // 86400000000, 0) AS obs_period_days,
      coalesce(any_value(mean_gap), 0) AS mean_time_between_events, coalesce(any_value(median_gap), 0) AS median_time_between_events
      FROM line LEFT JOIN gap_stats USING (subject_id) GROUP BY subject_id""",
    "static_one": """SELECT subject_id, arg_min(upper(trim(gender)), file_order) AS gender, arg_min(region, file_order) AS region
      FROM static_subjects GROUP BY subject_id""",
    "cohort": """SELECT m.*, is_case, site, gender, region, obs_period_days / 365.25 AS obs_period_years,
      CASE is_case WHEN 0 THEN 'Control' WHEN 1 THEN 'Cancer' END AS cancer_status
      FROM metrics m LEFT JOIN subject_labels USING (subject_id) LEFT JOIN static_one USING (subject_id)""",
}


def _long_sql(metrics, *by: str) -> str:
    columns = "".join(f"{b}, " for b in by)
    return " UNION ALL ".join(
        f"SELECT {columns}'{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM cohort" for m in metrics
    )


def cohort_rows(f):
    timelines, vocab = encoded(f)
    static = f.static().groupBy("subject_id").agg(
        F.min_by(F.upper(F.trim("gender")), F.when(F.col("gender").isNotNull(), F.col("file_order"))).alias("gender"),
        F.min_by("region", "file_order").alias("region"),
    )
    attributes = static.join(f.view("subject_labels"), "subject_id", "full")
    return cohort.cohort_table(cohort.sequence_metrics(timelines, vocab), attributes)


METRIC_COLUMNS = (
    "sequence_length num_medical_events unique_visits obs_period_days mean_time_between_events median_time_between_events"
).split()


@query(
    "seq_metrics",
    with_views(
        """SELECT subject_id, sequence_length, num_medical_events, unique_visits, obs_period_days,
round(mean_time_between_events, 6) AS mean_time_between_events, round(median_time_between_events, 6) AS median_time_between_events
FROM metrics""",
        *LABELLED,
        **COHORT_SQL,
    ),
)
def seq_metrics(f):
    df = cohort.sequence_metrics(*encoded(f))
    rounded = [F.round(c, 6).alias(c) if c.endswith("events") and c != "num_medical_events" else F.col(c) for c in METRIC_COLUMNS]
    return df.select("subject_id", *rounded)


DESCRIBED = [*cohort.METRICS, "median_time_between_events"]
DESCRIBE_SQL = """count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value), 4) AS min,
  round(max(value), 4) AS max, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS q1,
  round(quantile_cont(value, 0.75), 4) AS q3"""
STATS = ["mean", "median", "min", "max", "std", "q1", "q3"]


def _rounded(df, *keys: str):
    return df.select(*keys, "metric", "n", *[F.round(s, 4).alias(s) for s in STATS])


@query(
    "seq_describe",
    with_views(
        f"SELECT metric, {DESCRIBE_SQL} FROM long GROUP BY metric", *LABELLED, **COHORT_SQL, long=_long_sql(DESCRIBED)
    ),
)
def seq_describe(f):
    return _rounded(cohort.describe(cohort_rows(f), DESCRIBED))


def _describe_query(name: str, column: str) -> None:
    oracle = with_views(
        f"SELECT {column}, metric, {DESCRIBE_SQL} FROM long WHERE {column} IS NOT NULL GROUP BY {column}, metric",
        *LABELLED,
        **COHORT_SQL,
        long=_long_sql(DESCRIBED, column),
    )

    @query(name, oracle)
    def described(f):
        return _rounded(cohort.describe(cohort_rows(f), DESCRIBED, column), column)


_describe_query("seq_describe_by_status", "cancer_status")
_describe_query("seq_describe_by_site", "site")


@query(
    "value_counts_pct",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS subjects,
round(count(*) * 100.0 / (SELECT count(*) FROM cohort{w}), 2) AS percent FROM cohort{w or ' WHERE TRUE'} AND {c} IS NOT NULL GROUP BY {c}"""
            for c, w in (("gender", ""), ("region", ""), ("is_case", ""), ("site", " WHERE is_case = 1"))
        ),
        *LABELLED,
        **COHORT_SQL,
    ),
)
def value_counts_pct(f):
    rows = cohort_rows(f)
    df = cohort.value_counts_pct(rows, "gender")
    for column in ("region", "is_case"):
        df = df.unionByName(cohort.value_counts_pct(rows, column))
    return df.unionByName(cohort.value_counts_pct(rows, "site", F.col("is_case") == 1))


@query(
    "crosstab_margins",
    with_views(
        """SELECT coalesce(region, 'All') AS category, count(*) FILTER (is_case = 0) AS control, count(*) FILTER (is_case = 1) AS cancer,
count(*) AS total FROM cohort WHERE region IS NOT NULL AND is_case IS NOT NULL GROUP BY ROLLUP (region)""",
        *LABELLED,
        **COHORT_SQL,
    ),
)
def crosstab_margins(f):
    return cohort.crosstab_margins(cohort_rows(f), "region")


@query(
    "few_visits_share",
    with_views(
        """SELECT status, count(*) AS n, count(*) FILTER (unique_visits < 50) AS few,
round(count(*) FILTER (unique_visits < 50) * 100.0 / count(*), 2) AS percent
FROM (SELECT 'All' AS status, unique_visits FROM cohort UNION ALL SELECT cancer_status, unique_visits FROM cohort WHERE cancer_status IS NOT NULL)
GROUP BY status""",
        *LABELLED,
        **COHORT_SQL,
    ),
)
def few_visits_share(f):
    return cohort.few_visits_share(cohort_rows(f), limit=50)


@query(
    "gap_stats_positive",
    with_views(
        """SELECT status, metric, count(*) AS n, round(avg(value), 6) AS mean FROM (
  SELECT 'All' AS status, metric, value FROM long UNION ALL SELECT cancer_status, metric, value FROM long WHERE cancer_status IS NOT NULL)
WHERE value > 0 GROUP BY status, metric""",
        *LABELLED,
        **COHORT_SQL,
        long=_long_sql(["mean_time_between_events", "median_time_between_events"], "cancer_status"),
    ),
)
def gap_stats_positive(f):
    return cohort.gap_stats_positive(cohort_rows(f)).withColumn("mean", F.round("mean", 6))


BINNED_METRICS = ["sequence_length", "unique_visits", "num_medical_events"]


@query(
    "histogram_equal_width",
    with_views(
        """SELECT b.metric, b.bin, round(low + b.bin * (high - low) / 50, 6) AS low_edge, count(l.value) AS n
FROM (SELECT metric, min(value) AS low, max(value) AS high, unnest(range(50)) AS bin FROM long GROUP BY metric) b
LEFT JOIN long l ON l.metric = b.metric AND l.value >= low + b.bin * ((high - low) / 50)
  AND (l.value < low + (b.bin + 1) * ((high - low) / 50) OR b.bin = 49)
GROUP BY b.metric, b.bin, low, high""",
        *LABELLED,
        **COHORT_SQL,
        long=_long_sql(BINNED_METRICS),
    ),
)
def histogram_equal_width(f):
    df = cohort.histogram_equal_width(cohort_rows(f), BINNED_METRICS, 50)
    return df.withColumns({"low_edge": F.round("low_edge", 6), "bin": F.col("bin").cast("bigint")})


def _comparison_case(name: str, title: str) -> str:
    cells = ", ".join(
        f"coalesce(printf('%.2f', {fn}({name}) FILTER (is_case = {case})), 'nan') AS {label}_{stat}"
        for case, label in ((0, "control"), (1, "cancer"))
        for fn, stat in (("avg", "mean"), ("median", "median"))
    )
    return f"SELECT '{title}' AS metric, {cells} FROM cohort"


@query(
    "case_control_comparison",
    with_views(
        " UNION ALL ".join(_comparison_case(n, t) for n, t in cohort.METRICS.items()), *LABELLED, **COHORT_SQL
    ),
)
def case_control_comparison(f):
    return cohort.case_control_comparison(cohort_rows(f))


SUMMARY_SQL = """
SELECT 'Total Patients' AS metric, CAST(count(*) AS VARCHAR) AS value FROM cohort
UNION ALL SELECT 'Control Patients', CAST(count(*) FILTER (is_case = 0) AS VARCHAR) || ' (' || printf('%.1f', count(*) FILTER (is_case = 0) / count(*) * 100) || '%)' FROM cohort
UNION ALL SELECT 'Cancer Patients', CAST(count(*) FILTER (is_case = 1) AS VARCHAR) || ' (' || printf('%.1f', count(*) FILTER (is_case = 1) / count(*) * 100) || '%)' FROM cohort
UNION ALL SELECT 'Patients with < 5 Visits', CAST(count(*) FILTER (unique_visits < 5) AS VARCHAR) || ' (' || printf('%.1f', count(*) FILTER (unique_visits < 5) / count(*) * 100) || '%)' FROM cohort
UNION ALL SELECT '  - ' || site, CAST(count(*) AS VARCHAR) || ' (' || printf('%.1f', count(*) / (SELECT count(*) FROM cohort WHERE is_case = 1) * 100) || '%)' FROM cohort WHERE is_case = 1 GROUP BY site
UNION ALL SELECT 'Average Sequence Length', printf('%.1f', avg(sequence_length)) || ' ± ' || printf('%.1f', stddev_samp(sequence_length)) FROM cohort
UNION ALL SELECT 'Median Sequence Length', printf('%.1f', median(sequence_length)) FROM cohort
UNION ALL SELECT 'Average Unique Medical Events', printf('%.1f', avg(num_medical_events)) || ' ± ' || printf('%.1f', stddev_samp(num_medical_events)) FROM cohort
UNION ALL SELECT 'Average Unique Visits', printf('%.1f', avg(unique_visits)) || ' ± ' || printf('%.1f', stddev_samp(unique_visits)) FROM cohort
UNION ALL SELECT 'Average Observation Period', printf('%.2f', avg(obs_period_years)) || ' years (' || printf('%.0f', avg(obs_period_days)) || ' days)' FROM cohort
UNION ALL SELECT 'Median Observation Period', printf('%.2f', median(obs_period_years)) || ' years (' || printf('%.0f', median(obs_period_days)) || ' days)' FROM cohort
UNION ALL SELECT 'Mean Time Between Events', printf('%.2f', avg(mean_time_between_events)) || ' days' FROM cohort"""


@query("summary_table", with_views(SUMMARY_SQL, *LABELLED, **COHORT_SQL))
def summary_table(f):
    return cohort.summary_table(cohort_rows(f))


@query("metrics_sink", with_views(SUMMARY_SQL, *LABELLED, **COHORT_SQL))
def metrics_sink(f):
    path = stage_path(f, "summary")
    sinks.write_report(cohort.summary_table(cohort_rows(f)), path)
    return f.spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


# ---- subjects


@query(
    "validate_subjects",
    with_views(
        """SELECT subject_id, 'missing' AS status FROM (SELECT DISTINCT subject_id FROM meds_events) WHERE subject_id NOT IN (SELECT subject_id FROM subject_labels)
UNION ALL SELECT subject_id, 'extra' FROM (SELECT DISTINCT subject_id FROM subject_labels) WHERE subject_id NOT IN (SELECT subject_id FROM meds_events)""",
        ME,
        "subject_labels",
    ),
)
def validate_subjects(f):
    return subjects.validate_subjects(f.events(), f.view("subject_labels"))


@query("layout_validate_subjects", ORACLES["validate_subjects"])
def layout_validate_subjects(f):
    """Ids on one side only, both sides stored in buckets of subjects: no exchange."""
    folder = stage_path(f, "layout")
    for name, df in (("raw", f.events().select("subject_id", "seq")), ("labels", f.view("subject_labels"))):
        write_bucketed(df, f"{folder}/{name}")
    return subjects.validate_subjects(read_bucketed(f.spark, f"{folder}/raw"), read_bucketed(f.spark, f"{folder}/labels"))


@query("layout_narrative_dataset", ORACLES["narrative_dataset"])
def layout_narrative_dataset(f):
    """Narratives from timelines and labels stored in buckets of subjects."""
    folder = stage_path(f, "layout")
    timelines, vocab = encoded(f)
    sinks.write_timelines(timelines, f"{folder}/timelines", by_subject=True)
    write_bucketed(f.view("subject_labels"), f"{folder}/labels")
    stored = readers.read_timelines(f.spark, f"{folder}/timelines")
    return _shown_narratives(narratives.narrative_dataset(stored, phrases(f, vocab), read_bucketed(f.spark, f"{folder}/labels")))


@query(
    "validation_summary",
    with_views(
        """SELECT CAST(count(r) AS BIGINT) AS raw_subjects, CAST(count(t) AS BIGINT) AS tokenized_subjects,
count(*) FILTER (r IS NOT NULL AND t IS NULL) AS missing, count(*) FILTER (r IS NULL AND t IS NOT NULL) AS extra
FROM (SELECT DISTINCT subject_id AS r FROM meds_events) FULL JOIN (SELECT DISTINCT subject_id AS t FROM subject_labels) ON r = t""",
        ME,
        "subject_labels",
    ),
)
def validation_summary(f):
    return subjects.validation_summary(f.events(), f.view("subject_labels"))


@query(
    "shard_index",
    with_views(
        """SELECT subject_id, 1 AS has_shard, CAST(subject_id IN (SELECT subject_id FROM subject_notes) AS INTEGER) AS has_notes
FROM (SELECT DISTINCT subject_id FROM meds_events)""",
        ME,
        "subject_notes",
    ),
)
def shard_index(f):
    timelines, notes = stage_path(f, "timelines"), stage_path(f, "notes")
    sinks.write_timelines(encoded(f)[0], timelines)
    f.view("subject_notes").write.parquet(notes)
    index = subjects.shard_index(f.spark.read.parquet(timelines), f.spark.read.parquet(notes))
    return index.select(
        "subject_id",
        F.col("ehr_shard_filepath").isNotNull().cast("int").alias("has_shard"),
        F.col("clinical_note_shard_filepath").isNotNull().cast("int").alias("has_notes"),
    )


TIME_TEXT = """CASE WHEN {d} = 0 THEN 'T0' WHEN {d} / 31557600.0 >= 1 THEN '+' || printf('%.1f', {d} / 31557600.0) || ' years'
  WHEN {d} / 86400.0 >= 1 THEN '+' || printf('%.0f', {d} / 86400.0) || ' days'
  WHEN {d} / 3600.0 >= 1 THEN '+' || printf('%.0f', {d} / 3600.0) || ' hours'
  WHEN {d} / 60.0 >= 1 THEN '+' || printf('%.0f', {d} / 60.0) || ' minutes' ELSE '+' || printf('%.0f', {d}) || ' seconds' END"""


LOOKED_AT = """SELECT subject_id, kind, text, ts_us, row_number() OVER w AS pos,
CASE WHEN ts_us = 0 THEN 'None' WHEN kind = 'ehr' AND text = 'MEDS_BIRTH' THEN 'T0'
  WHEN p IS NULL OR p = 0 THEN CASE WHEN birth <> 0 THEN {since_birth} ELSE 'T0' END
  WHEN p = ts_us THEN '-' ELSE {since} END AS gap
FROM (SELECT *, lag(ts_us) OVER w AS p FROM both_rows WINDOW w AS (PARTITION BY subject_id ORDER BY CAST(ts_us <> 0 AS INT), ts_us, source, pos))
LEFT JOIN births USING (subject_id) {which}
WINDOW w AS (PARTITION BY subject_id ORDER BY CAST(ts_us <> 0 AS INT), ts_us, source, pos)"""


def _looked_at(which: str = "") -> str:
    times = {"since_birth": TIME_TEXT.format(d="((ts_us - birth) / 1e6)"), "since": TIME_TEXT.format(d="((ts_us - p) / 1e6)")}
    return with_views(
        LOOKED_AT.format(**times, which=which),
        ME,
        "subject_notes",
        **LONG,
        decoded="SELECT subject_id, pos, ts_us, str FROM line JOIN vocab USING (token)",
        births="SELECT subject_id, arg_min(ts_us, pos) AS birth FROM decoded WHERE str = 'MEDS_BIRTH' GROUP BY subject_id",
        note_rows="""SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY charttime, text) AS pos,
          epoch_us(CAST(charttime AS TIMESTAMP)) AS ts_us, text FROM subject_notes WHERE subject_id IN (SELECT subject_id FROM ends)""",
        both_rows="""SELECT subject_id, 'ehr' AS kind, 0 AS source, pos, ts_us, str AS text FROM decoded
          UNION ALL SELECT subject_id, 'note', 1, pos, ts_us, text FROM note_rows""",
    )


def _numbered_notes(f):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("subject_id").orderBy("charttime", "text"))
    return f.view("subject_notes").withColumn("note_order", order)


def _shown_timeline(df):
    from catalog.sequences import with_positions
    from eventloom.ordering import order_groups

    df = df.withColumn("timed", (F.col("ts") != 0).cast("int"))
    placed = with_positions(order_groups(df, ["subject_id"], ["timed", "ts", "source", "place"]))
    ts = F.round(F.col("ts") * 1e6).cast("bigint").alias("ts_us")
    return placed.select("subject_id", "kind", "text", ts, "pos", "gap")


@query("subject_timeline", _looked_at())
def subject_timeline(f):
    timelines, vocab = encoded(f)
    return _shown_timeline(subjects.subject_timeline(timelines.drop("split"), vocab, _numbered_notes(f)))


@query(
    "subject_lookup",
    _looked_at("WHERE subject_id = (SELECT subject_id FROM line GROUP BY subject_id ORDER BY count(*) DESC, subject_id LIMIT 1)"),
)
def subject_lookup(f):
    """The longest timeline, read through an index of the files of all timelines and notes."""
    from eventloom.sources.file_index import FileIndex

    timelines, vocab = encoded(f)
    folder = stage_path(f, "lookup")
    timelines.write.parquet(f"{folder}/timelines")
    _numbered_notes(f).write.parquet(f"{folder}/notes")
    indexes = [FileIndex(f.spark, f"{folder}/{name}", f"{folder}/{name}-index").build() for name in ("timelines", "notes")]
    written = f.spark.read.parquet(f"{folder}/timelines")
    longest = written.orderBy(F.size("tokens").desc(), "subject_id").first()["subject_id"]
    found = subjects.look_up_subject(indexes[0], vocab, longest, indexes[1])
    return _shown_timeline(found.drop("split"))


@query(
    "time_delta_text",
    with_views(
        f"SELECT subject_id, seq, {TIME_TEXT.format(d='secs')} AS text FROM (SELECT subject_id, seq, coalesce(epoch_us(time), 0) / 1e6 AS secs FROM {ME})",
        ME,
    ),
)
def time_delta_text(f):
    from eventloom.functions.gaps import elapsed_text
    from eventloom.schema import epoch_seconds

    return f.events().select("subject_id", "seq", elapsed_text(epoch_seconds()).alias("text"))




@query(
    "sequence_store",
    with_views(
        "SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY pos) - 1 AS pos, token, ts_us FROM line", ME, **LONG
    ),
)
def sequence_store(f):
    """Every token of every timeline from blocks of a store; subjects above 40 events are cut, whatever the session's limit."""
    from eventloom.ordering import order_groups
    from eventloom.sources.sequences import write_sequences

    rows = standard_tokens(f)
    rows = rows.with_df(materialize(rows.df, "token-rows"))
    tokenizer = WordLevel(VOCAB_SIZE).train(train_tokens(rows))
    cut = order_groups(rows.df.drop("chunk"), rows.keys, rows.order, limit=40)
    blocks = write_sequences(tokenizer, cut, stage_path(f, "sequences")).all()
    each = blocks.select("subject_id", "offset", F.posexplode(F.arrays_zip("tokens", "timestamps")).alias("at", "t"))
    ts = F.round(F.col("t.timestamps") * 1e6).cast("bigint").alias("ts_us")
    return each.select("subject_id", (F.col("offset") + F.col("at")).alias("pos"), F.col("t.tokens").alias("token"), ts)
