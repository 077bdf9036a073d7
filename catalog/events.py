"""Operators over the event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.fixtures import with_views
from catalog.registry import EVENT, EVENT_SQL, query, shown
from eventloom.functions.quantiles import even_probabilities
from eventloom.functions.match import code_matches, is_real_event
from eventloom.functions.text import fixed_text, float_text
from eventloom.operators import ages
from eventloom.operators.base import value_number, value_text
from eventloom.operators.codes import CodeEnrichment, CodeTruncation, code_id
from eventloom.operators.filters import DropBirth, FilterEvents, TopKCodes
from eventloom.operators.measurements import DemographicAggregation
from eventloom.operators.phrases import one_decimal
from eventloom.operators.static import LoadStaticData, clean_value
from eventloom.operators.values import QuantileBin, QuantileBin3Level, RoundNumeric
from eventloom.plans.chain import apply_operators, fit_operators
from eventloom.schema import event_table

ME = "meds_events"
EVENT_TEXT_SQL = "subject_id, epoch_us(time) AS t_us, code, {numeric} AS numeric_value, {text} AS text_value"
TRAIN = "split = 'train'"

MATCHES = {
    "starts_with": ("LAB//", "starts_with(code, 'LAB//')"),
    "ends_with": ("mg/dL", "ends_with(code, 'mg/dL')"),
    "contains": ("//9", "contains(code, '//9')"),
    "equals": ("MEDICAL//bmi", "code = 'MEDICAL//bmi'"),
    "regex": ("^(LAB|MEDICATION)//.*[02468]", "regexp_matches(code, '^(LAB|MEDICATION)//.*[02468]')"),
}


def _match_query(kind: str, value: str, sql: str) -> None:
    oracle = with_views(
        f"SELECT subject_id, seq, code, CAST(coalesce({sql} AND code <> '', FALSE) AS INTEGER) AS matched FROM {ME}", ME
    )

    @query(f"match_{kind}", oracle)
    def matched(f):
        return f.events().select("subject_id", "seq", "code", code_matches(kind, value).cast("int").alias("matched"))


for _kind, (_value, _sql) in MATCHES.items():
    _match_query(_kind, _value, _sql)


@query(
    "filter_events",
    with_views(
        f"""
SELECT 'drop' AS mode, {EVENT_SQL} FROM {ME} WHERE NOT starts_with(code, 'LAB//')
UNION ALL SELECT 'keep', {EVENT_SQL} FROM {ME} WHERE starts_with(code, 'LAB//')
UNION ALL SELECT 'pass', {EVENT_SQL} FROM {ME}
""",
        ME,
    ),
)
def filter_events(f):
    events = f.events()
    modes = {
        "drop": FilterEvents("starts_with", "LAB//"),
        "keep": FilterEvents("starts_with", "LAB//", invert="true"),
        "pass": FilterEvents("ends_with", "mg/dL"),
    }
    parts = [shown(op.transform(events).withColumn("mode", F.lit(m)), "mode", *EVENT) for m, op in modes.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


# The noise filters and the allow list of the shipped ICU configuration.
ICU_NOISE = [
    ("starts_with", "AGE"), ("starts_with", "TIME_OF_DAY"), ("contains", "//22"), ("contains", "Height"),
    ("contains", "Weight"),
]
ICU_ALLOWED = (
    "^(LAB//|MEDICATION//|PROCEDURE//|DIAGNOSIS//|HOSPITAL|ICU|DRG|SERVICES|SOFA|GENDER|AGE|BMI|RACE|"
    "MARITAL_STATUS|Blood Pressure|MEDS_BIRTH|BMI (kg/m2)|BMI//|MEDS_DEATH)"
)


@query(
    "filter_chain",
    with_views(
        f"""
SELECT {EVENT_SQL} FROM {ME}
WHERE NOT starts_with(code, 'AGE') AND NOT starts_with(code, 'TIME_OF_DAY') AND NOT contains(code, '//22')
  AND NOT contains(code, 'Height') AND NOT contains(code, 'Weight') AND regexp_matches(code, '{ICU_ALLOWED}')
""",
        ME,
    ),
)
def filter_chain(f):
    ops = [FilterEvents(*noise) for noise in ICU_NOISE] + [FilterEvents("regex", ICU_ALLOWED, "true")]
    return shown(apply_operators(ops, f.events()), *EVENT)


@query(
    "top_k_filter",
    with_views(
        f"""
SELECT {EVENT_SQL} FROM {ME} WHERE NOT starts_with(code, 'LAB//') OR code IN (SELECT code FROM top)
""",
        ME,
        top=f"""SELECT code FROM {ME} WHERE {TRAIN} AND starts_with(code, 'LAB//')
            GROUP BY code ORDER BY count(*) DESC, code LIMIT 6""",
    ),
)
def top_k_filter(f):
    events = f.events()
    return shown(TopKCodes("starts_with", "LAB//", k=6).fit(events.where(TRAIN)).transform(events), *EVENT)


@query(
    "agg_code_counts",
    with_views(f"SELECT code, count(*) AS n FROM {ME} WHERE {TRAIN} GROUP BY code", ME),
)
def agg_code_counts(f):
    return f.events().where(TRAIN).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct_subjects", with_views(f"SELECT DISTINCT subject_id FROM {ME}", ME))
def agg_distinct_subjects(f):
    return f.events().select("subject_id").distinct()


@query(
    "agg_quantiles",
    with_views(
        f"""SELECT code, round(quantile_cont(numeric_value, 0.25), 6) AS q1, round(quantile_cont(numeric_value, 0.5), 6) AS q2,
        round(quantile_cont(numeric_value, 0.75), 6) AS q3 FROM {ME}
        WHERE numeric_value IS NOT NULL GROUP BY code""",
        ME,
    ),
)
def agg_quantiles(f):
    from eventloom.functions.quantiles import exact_quantiles

    rows = f.events()
    edges = exact_quantiles(rows, ["code"], "numeric_value", [0.25, 0.5, 0.75])
    return edges.select("code", *[F.round(F.get("edges", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(3)])


@query(
    "real_event_predicate",
    with_views(
        f"""SELECT subject_id, seq,
  CAST(coalesce(time IS NOT NULL AND code <> 'MEDS_BIRTH' AND code <> 'STATIC_DATA_NO_CODE'
    AND NOT starts_with(code, 'DEMOGRAPHICS//') AND NOT starts_with(code, 'RACE//')
    AND NOT starts_with(code, 'MARITAL_STATUS//'), FALSE) AS INTEGER) AS ethos_real,
  CAST(coalesce(time IS NOT NULL AND code <> 'MEDS_BIRTH' AND code <> 'STATIC_DATA_NO_CODE'
    AND NOT starts_with(code, 'DEMOGRAPHICS//') AND NOT starts_with(code, 'GENDER//')
    AND NOT starts_with(code, 'ETHNICITY//') AND NOT starts_with(code, 'REGION//'), FALSE) AS INTEGER) AS common_real
FROM {ME}""",
        ME,
    ),
)
def real_event_predicate(f):
    return f.events().select(
        "subject_id",
        "seq",
        is_real_event(ages.ETHOS_EXCLUDED).cast("int").alias("ethos_real"),
        is_real_event(ages.COMMON_EXCLUDED).cast("int").alias("common_real"),
    )


@query("drop_birth", with_views(f"SELECT {EVENT_SQL} FROM {ME} WHERE code <> 'MEDS_BIRTH'", ME))
def drop_birth(f):
    return shown(DropBirth().transform(f.events()), *EVENT)


BMI = {"token_pattern": "MEDICAL//bmi", "value_column": "numeric_value", "token_prefix": "BMI//"}


@query(
    "remove_original_measurements",
    with_views(f"SELECT {EVENT_SQL} FROM {ME} WHERE code <> 'MEDICAL//bmi'", ME),
)
def remove_original_measurements(f):
    op = DemographicAggregation([{**BMI, "aggregation": "mean", "remove_original_tokens": True}])
    kept = op.transform(f.events()).where("code <> 'BMI'")
    return shown(kept, *EVENT)


# ---- row-level projections


@query(
    "code_truncation",
    with_views(
        f"""SELECT subject_id, seq, CASE WHEN contains(code, '//')
        THEN array_to_string(list_slice(string_split(code, '//'), 1, 2), '//') ELSE code END AS code FROM {ME}""",
        ME,
    ),
)
def code_truncation(f):
    return CodeTruncation("contains", "//").transform(f.events()).select("subject_id", "seq", "code")


@query(
    "round_numeric",
    with_views(
        f"""SELECT subject_id, seq, code, CASE WHEN starts_with(code, 'LAB//') THEN printf('%.1f', numeric_value)
        ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value FROM {ME}""",
        ME,
    ),
)
def round_numeric(f):
    op = RoundNumeric("starts_with", "LAB//", "numeric_value", decimals=1)
    return op.transform(f.events()).select("subject_id", "seq", "code", "numeric_value")


@query(
    "value_cast",
    with_views(
        f"""SELECT subject_id, seq, TRY_CAST(text_value AS DOUBLE) AS text_number,
        CAST(numeric_value AS VARCHAR) AS number_text FROM {ME}""",
        ME,
    ),
)
def value_cast(f):
    events = f.events()
    return events.select(
        "subject_id",
        "seq",
        value_number(events, "text_value").alias("text_number"),
        value_text(events, "numeric_value").alias("number_text"),
    )


@query(
    "code_id_extract",
    with_views(
        f"""SELECT subject_id, seq, CASE
  WHEN starts_with(code, 'DIAGNOSIS//ICD//') THEN coalesce(string_split(code, '//')[4], code)
  ELSE coalesce(string_split(code, '//')[2], code) END AS code_id FROM {ME}""",
        ME,
    ),
)
def code_id_extract(f):
    return f.events().select("subject_id", "seq", code_id(F.col("code")).alias("code_id"))


GENDER = {
    "column_name": "gender", "code_template": "DEMOGRAPHICS//GENDER", "value_prefix": "GENDER//",
    "insert_code": False, "mappings": {"male": "M", "FEMALE": "F"},
}
MARITAL = {
    "column_name": "marital_status", "code_template": "DEMOGRAPHICS//MARITAL_STATUS", "insert_code": True,
    "valid_values": ["BUILDING", "MACHINERY", "HOUSE"], "mappings": {"HOUSEHOLD": "HOUSE"},
    "map_invalids_to": "MARITAL_STATUS_UNKNOWN", "value_prefix": "MARITAL_STATUS//",
}
GENDER_SQL = """CASE WHEN gender IS NULL THEN 'UNKNOWN' WHEN upper(trim(gender)) = 'FEMALE' THEN 'F' ELSE upper(trim(gender)) END"""
MARITAL_SQL = """CASE WHEN marital_status IS NULL THEN 'MARITAL_STATUS_UNKNOWN'
  WHEN upper(trim(marital_status)) = 'HOUSEHOLD' THEN 'HOUSE'
  WHEN upper(trim(marital_status)) IN ('BUILDING', 'MACHINERY', 'HOUSE') THEN upper(trim(marital_status))
  ELSE 'MARITAL_STATUS_UNKNOWN' END"""


@query(
    "clean_value",
    with_views(
        f"SELECT subject_id, file_order, {GENDER_SQL} AS gender, {MARITAL_SQL} AS marital FROM static_subjects",
        "static_subjects",
    ),
)
def clean_values(f):
    return f.static().select(
        "subject_id",
        "file_order",
        clean_value(F.col("gender"), GENDER).alias("gender"),
        clean_value(F.col("marital_status"), MARITAL).alias("marital"),
    )


STATIC_ROWS = {
    "first_static": f"""SELECT subject_id, arg_min(gender, file_order) AS g, arg_min(marital_status, file_order) AS m,
      count(*) AS n FROM (SELECT subject_id, file_order, {GENDER_SQL} AS gender, {MARITAL_SQL} AS marital_status
      FROM static_subjects) GROUP BY subject_id""",
    "subjects": f"SELECT DISTINCT subject_id FROM {ME}",
    "static_rows": """
      SELECT s.subject_id, 'STATIC_DATA_NO_CODE' AS code, 'GENDER//' || coalesce(g, 'UNKNOWN') AS text_value, 0 AS i
      FROM subjects s LEFT JOIN first_static USING (subject_id)
      UNION ALL
      SELECT s.subject_id, 'DEMOGRAPHICS//MARITAL_STATUS', 'MARITAL_STATUS//' || coalesce(m, 'MARITAL_STATUS_UNKNOWN'), 1
      FROM subjects s LEFT JOIN first_static USING (subject_id)""",
}


def static_operator(f):
    return LoadStaticData(f.static(), "subject_id", [GENDER, MARITAL])


@query(
    "load_static_data",
    with_views(
        f"""SELECT {EVENT_SQL} FROM {ME}
UNION ALL SELECT subject_id, NULL, code, NULL, text_value FROM static_rows""",
        ME,
        "static_subjects",
        **STATIC_ROWS,
    ),
)
def load_static_data(f):
    return shown(static_operator(f).fit_transform(f.events()), *EVENT)


@query(
    "prefix_and_code_toggle",
    with_views("SELECT subject_id, code, text_value FROM static_rows", ME, "static_subjects", **STATIC_ROWS),
)
def prefix_and_code_toggle(f):
    rows = static_operator(f).fit_transform(f.events()).where("seq < -1")
    return rows.select("subject_id", "code", "text_value")


@query(
    "schema_align",
    with_views(
        f"""SELECT subject_id, split, CAST(seq AS BIGINT) AS seq, code, unit FROM {ME}
UNION ALL SELECT subject_id, any_value(split), CAST(-1000000000 AS BIGINT), 'STATIC_DATA_NO_CODE', NULL FROM {ME} GROUP BY subject_id
UNION ALL SELECT subject_id, any_value(split), CAST(-999999999 AS BIGINT), 'DEMOGRAPHICS//MARITAL_STATUS', NULL FROM {ME} GROUP BY subject_id""",
        ME,
    ),
)
def schema_align(f):
    return static_operator(f).fit_transform(f.events()).select("subject_id", "split", "seq", "code", "unit")


@query(
    "static_distribution",
    with_views(
        """
SELECT column_name, value, count(*) AS subjects, round(count(*) * 100.0 / (SELECT count(*) FROM first_static), 1) AS percent
FROM (SELECT 'gender' AS column_name, g AS value FROM first_static UNION ALL SELECT 'marital_status', m FROM first_static)
GROUP BY column_name, value""",
        ME,
        "static_subjects",
        **STATIC_ROWS,
    ),
)
def static_distribution(f):
    return static_operator(f).fit(f.events()).distribution()


@query(
    "static_match_rate",
    with_views(
        """
SELECT count(*) AS subjects, count(n) AS found, count(*) - count(n) AS missing, round(count(n) * 100.0 / count(*), 1) AS percent
FROM subjects LEFT JOIN first_static USING (subject_id)""",
        ME,
        "static_subjects",
        **STATIC_ROWS,
    ),
)
def static_match_rate(f):
    events = f.events()
    return static_operator(f).fit(events).match_rate(events.select("subject_id"))


@query(
    "text_value_fill",
    with_views(f"SELECT subject_id, seq, CAST(NULL AS VARCHAR) AS text_value, CAST(NULL AS VARCHAR) AS unit FROM {ME}", ME),
)
def text_value_fill(f):
    return event_table(f.view(ME).drop("text_value", "unit")).select("subject_id", "seq", "text_value", "unit")


@query(
    "format_value_1dp",
    with_views(
        f"""SELECT subject_id, seq, CASE WHEN trim(text_value) = '___' THEN ''
        WHEN TRY_CAST(text_value AS DOUBLE) IS NOT NULL THEN printf('%.1f', TRY_CAST(text_value AS DOUBLE))
        ELSE text_value END AS text_1dp, printf('%.1f', numeric_value) AS number_1dp FROM {ME}""",
        ME,
    ),
)
def format_value_1dp(f):
    number = fixed_text(F.col("numeric_value"), 1)
    return f.events().select(
        "subject_id", "seq", one_decimal(F.col("text_value")).alias("text_1dp"), number.alias("number_1dp")
    )


# ---- fitted operators


def edges_sql(column: str, prefix: str, k: int, source: str = ME) -> str:
    cells = ", ".join(f"quantile_cont(v, {p!r})" for p in even_probabilities(k)[1:-1])
    return f"""SELECT code, [{cells}] AS edges FROM (
      SELECT code, {column} AS v FROM {source} WHERE {TRAIN} AND starts_with(code, '{prefix}')) WHERE v IS NOT NULL GROUP BY code"""


BIN_SQL = "'Q' || CAST(len(list_filter(edges, lambda e: e <= {v})) AS VARCHAR)"


def binned_sql(column: str, number: str, text: str, prefix: str) -> str:
    label = BIN_SQL.format(v=number)
    return f"""SELECT subject_id, seq, e.code, CASE WHEN {column} IS NULL THEN NULL
      WHEN starts_with(e.code, '{prefix}') AND {number} IS NOT NULL THEN CASE WHEN edges IS NULL THEN CAST({number} AS VARCHAR) ELSE {label} END
      ELSE {text} END AS {column} FROM {ME} e LEFT JOIN edges q ON e.code = q.code"""


@query(
    "quantile_bin",
    with_views(
        binned_sql("numeric_value", "numeric_value", "CAST(numeric_value AS VARCHAR)", "LAB"),
        ME,
        edges=edges_sql("numeric_value", "LAB", 10),
    ),
)
def quantile_bin(f):
    events = f.events()
    op = QuantileBin("starts_with", "LAB", 10, "numeric_value").fit(events.where(TRAIN))
    return op.transform(events).select("subject_id", "seq", "code", "numeric_value")


@query(
    "quantile_bin_text",
    with_views(
        binned_sql("text_value", "TRY_CAST(text_value AS DOUBLE)", "text_value", "BMI"),
        ME,
        edges=edges_sql("TRY_CAST(text_value AS DOUBLE)", "BMI", 10),
    ),
)
def quantile_bin_text(f):
    events = f.events()
    op = QuantileBin("starts_with", "BMI", 10, "text_value").fit(events.where(TRAIN))
    return op.transform(events).select("subject_id", "seq", "code", "text_value")


LEVELS_SQL = f"""SELECT subject_id, seq, e.code, CASE WHEN numeric_value IS NULL THEN NULL
  WHEN starts_with(e.code, 'LAB//') AND edges IS NOT NULL THEN
    CASE WHEN numeric_value < edges[1] THEN 'low' WHEN numeric_value <= edges[3] THEN 'normal' ELSE 'high' END
  ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value FROM {ME} e LEFT JOIN edges q ON e.code = q.code"""


@query("quantile_bin_3level", with_views(LEVELS_SQL, ME, edges=edges_sql("numeric_value", "LAB//", 4)))
def quantile_bin_3level(f):
    events = f.events()
    op = QuantileBin3Level("starts_with", "LAB//", "numeric_value").fit(events.where(TRAIN))
    return op.transform(events).select("subject_id", "seq", "code", "numeric_value")


@query(
    "fit_jointly",
    with_views(
        """
SELECT 'bin' AS operator, code, array_to_string(list_transform(edges, lambda e: CAST(round(e, 4) AS VARCHAR)), '|') AS inner_edges FROM lab
UNION ALL SELECT 'level', code, array_to_string(list_transform(edges, lambda e: CAST(round(e, 4) AS VARCHAR)), '|') FROM med""",
        ME,
        short=f"""SELECT * REPLACE (CASE WHEN contains(code, '//') THEN array_to_string(list_slice(string_split(code, '//'), 1, 2), '//')
          ELSE code END AS code) FROM {ME}""",
        lab=edges_sql("numeric_value", "LAB//", 5, "short"),
        med=edges_sql("numeric_value", "MEDICAL//", 4, "short"),
    ),
)
def fit_jointly(f):
    ops = jointly_fitted()
    fit_operators(ops, f.events().where(TRAIN))
    return shown_joint_edges(ops)


def jointly_fitted() -> list:
    return [
        QuantileBin("starts_with", "LAB//", 5, "numeric_value"),
        QuantileBin3Level("starts_with", "MEDICAL//", "numeric_value"),
        CodeTruncation("contains", "//"),
    ]


def shown_joint_edges(ops: list):
    def shown_edges(name: str, edges) -> list:
        text = F.array_join(F.transform(edges, lambda e: float_text(F.round(e, 4))), "|")
        return [F.lit(name).alias("operator"), "code", text.alias("inner_edges")]

    bins = ops[0].fitted.select(*shown_edges("bin", F.slice("edges", 2, 4)))
    return bins.unionByName(ops[1].fitted.select(*shown_edges("level", F.col("edges"))))


AGG_FUNCTIONS = {"mean": "CAST(sum(CAST(v AS DECIMAL(38, 9))) AS DOUBLE) / count(v)", "min": "min(v)", "max": "max(v)", "median": "median(v)"}


def subject_values_sql(kind: str) -> str:
    return f"""SELECT subject_id, any_value(split) AS split, {AGG_FUNCTIONS[kind]} AS value FROM (
      SELECT subject_id, split, numeric_value AS v FROM {ME} WHERE starts_with(code, 'MEDICAL//bmi')) WHERE v IS NOT NULL GROUP BY subject_id"""


def bmi_edges_sql(bins: int) -> str:
    cells = ", ".join(f"quantile_cont(value, {p!r})" for p in even_probabilities(bins)[1:-1])
    return f"SELECT [{cells}] AS edges FROM subject_values WHERE {TRAIN}"


INSERTED_SQL = "SELECT subject_id, code, text_value FROM inserted"


def _inserted(df):
    return df.where("seq < -1").select("subject_id", "code", "text_value")


def _aggregation_query(kind: str) -> None:
    oracle = with_views(
        INSERTED_SQL,
        ME,
        subject_values=subject_values_sql(kind),
        bins=bmi_edges_sql(4),
        inserted="SELECT subject_id, 'STATIC_DATA_NO_CODE' AS code, 'BMI//Q' || "
        "CAST(len(list_filter(edges, lambda e: e <= value)) + 1 AS VARCHAR) AS text_value FROM subject_values, bins",
    )

    @query(f"demographic_agg_{kind}", oracle)
    def aggregated(f):
        events = f.events()
        op = DemographicAggregation([{**BMI, "aggregation": kind, "num_bins": 4, "insert_code": False}])
        return _inserted(op.fit(events.where(TRAIN)).transform(events))


for _kind in AGG_FUNCTIONS:
    _aggregation_query(_kind)


@query(
    "demographic_aggregation",
    with_views(
        f"""SELECT {EVENT_SQL} FROM {ME} WHERE code <> 'MEDICAL//bmi'
UNION ALL SELECT subject_id, NULL, 'BMI', NULL, 'Q' || CAST(len(list_filter(edges, lambda e: e <= value)) + 1 AS VARCHAR)
FROM subject_values, bins""",
        ME,
        subject_values=subject_values_sql("median"),
        bins=bmi_edges_sql(10),
    ),
)
def demographic_aggregation(f):
    events = f.events()
    op = DemographicAggregation([{**BMI, "aggregation": "median", "num_bins": 10, "remove_original_tokens": True}])
    return shown(op.fit(events.where(TRAIN)).transform(events), *EVENT)


@query(
    "demographic_agg_raw",
    with_views(
        "SELECT subject_id, 'MEDICAL//BMI' AS code, printf('%.1f', value) AS text_value FROM subject_values",
        ME,
        subject_values=subject_values_sql("median"),
    ),
)
def demographic_agg_raw(f):
    op = DemographicAggregation([{**BMI, "token_prefix": "MEDICAL//BMI", "aggregation": "median", "decimals": 1}])
    return _inserted(op.fit_transform(f.events()))


WEIGHT_LABELS = ["very low", "low", "normal", "high", "very high"]


@query(
    "demographic_agg_labels",
    with_views(
        f"""SELECT subject_id, 'BMI' AS code, {WEIGHT_LABELS!r}[len(list_filter(edges, lambda e: e <= value)) + 1] AS text_value
FROM subject_values, bins""",
        ME,
        subject_values=subject_values_sql("median"),
        bins=bmi_edges_sql(5),
    ),
)
def demographic_agg_labels(f):
    events = f.events()
    op = DemographicAggregation([{**BMI, "aggregation": "median", "num_bins": 5, "bin_labels": WEIGHT_LABELS}])
    return _inserted(op.fit(events.where(TRAIN)).transform(events))


@query(
    "code_enrichment",
    with_views(
        f"""SELECT e.subject_id, e.seq, CASE
  WHEN starts_with(e.code, 'LAB//') AND l.itemid IS NOT NULL
    THEN '<LAB> ' || CAST(l.itemid AS VARCHAR) || ' ' || l.label || ' (' || l.category || ') </LAB>'
  WHEN starts_with(e.code, 'DIAGNOSIS//ICD//10//') AND i.icd_code IS NOT NULL
    THEN '<DX> ' || i.long_title || ' </DX>'
  ELSE e.code END AS code
FROM {ME} e
LEFT JOIN lookup_labitems l ON starts_with(e.code, 'LAB//') AND TRY_CAST(string_split(e.code, '//')[2] AS BIGINT) = l.itemid
LEFT JOIN (SELECT * FROM lookup_icd WHERE icd_version = 10) i ON string_split(e.code, '//')[4] = i.icd_code""",
        ME,
        "lookup_labitems",
        "lookup_icd",
    ),
)
def code_enrichment(f):
    ops = [
        CodeEnrichment(
            "starts_with", "LAB//", f.labitems(), "<LAB> {itemid} {label} ({category}) </LAB>", "itemid"
        ),
        CodeEnrichment(
            "starts_with", "DIAGNOSIS//ICD//10//", f.icd(), "<DX> {long_title} </DX>", "icd_code",
            {"icd_code": "string"}, {"icd_version": 10},
        ),
    ]
    events = f.events()
    return apply_operators(fit_operators(ops, events.where(TRAIN)), events).select("subject_id", "seq", "code")


# ---- ages

AGES_SQL = f"""SELECT subject_id, (epoch_us(first_event) - epoch_us(birth)) / 1e6 / 31557600.0 AS age FROM (
  SELECT subject_id, min(time) FILTER (code = 'MEDS_BIRTH') AS birth, count(*) FILTER (code = 'MEDS_BIRTH') AS births,
    min(time) FILTER (code <> 'MEDS_BIRTH' AND code <> 'STATIC_DATA_NO_CODE') AS first_event FROM {ME} GROUP BY subject_id)
  WHERE births > 0"""


@query("age_at_first_event", with_views("SELECT subject_id, round(age, 6) AS age FROM ages", ME, ages=AGES_SQL))
def age_at_first_event(f):
    births = ages.births_and_first_events(f.events(), ages.COMMON_EXCLUDED)
    return births.select("subject_id", F.round(ages.age_at_first_event(), 6).alias("age"))


def _age_query(name: str, make, inserted: str, numeric: str = "numeric_value") -> None:
    oracle = with_views(
        f"""SELECT subject_id, epoch_us(time) AS t_us, code, numeric_value, text_value FROM {ME} WHERE code <> 'MEDS_BIRTH'
UNION ALL {inserted}""",
        ME,
        ages=AGES_SQL,
        scaled="SELECT subject_id, least(age * 100 / 100, 99.0) AS s FROM ages",
        digits="""SELECT subject_id, CAST(floor(s / 10) AS BIGINT) AS a, CAST(round_even(s - 10 * floor(s / 10), 0) AS BIGINT) AS b FROM scaled""",
    )

    @query(name, oracle)
    def aged(f):
        return shown(make().transform(f.events()), *EVENT)


_age_query(
    "ethos_quantile_age",
    ages.EthosQuantileAge,
    """SELECT subject_id, NULL, 'AGE_T1', NULL, 'Q' || CAST(CASE WHEN b = 10 THEN a + 2 ELSE a + 1 END AS VARCHAR) FROM digits
UNION ALL SELECT subject_id, NULL, 'AGE_T2', NULL, 'Q' || CAST(CASE WHEN b = 10 THEN 1 ELSE b + 1 END AS VARCHAR) FROM digits""",
)
_age_query(
    "decimal_age",
    ages.DecimalAge,
    """SELECT subject_id, NULL, 'AGE_decile', NULL, 'Q' || CAST(CAST(floor(age) AS BIGINT) // 10 AS VARCHAR) FROM ages WHERE age >= 0
UNION ALL SELECT subject_id, NULL, 'AGE_unit', NULL, 'Q' || CAST(CAST(floor(age) AS BIGINT) % 10 AS VARCHAR) FROM ages WHERE age >= 0""",
)
_age_query(
    "binned_age",
    ages.BinnedAge,
    """SELECT subject_id, NULL, 'AGE: ' || CAST(CAST(floor(age / 5) * 5 AS BIGINT) AS VARCHAR) || '-' ||
CAST(CAST(floor(age / 5) * 5 AS BIGINT) + 4 AS VARCHAR), NULL, NULL FROM ages WHERE age >= 20 AND age < 100""",
)
_age_query(
    "raw_age",
    ages.RawAge,
    "SELECT subject_id, NULL, 'AGE', round_even(age, 0), NULL FROM ages WHERE age >= 0",
)


@query(
    "raw_age_text",
    with_views(
        "SELECT subject_id, printf('%.0f', age) AS numeric_value FROM ages WHERE age >= 0", ME, ages=AGES_SQL
    ),
)
def raw_age_text(f):
    aged = ages.RawAge(as_int_text=True).transform(f.events())
    return aged.where("code = 'AGE'").select("subject_id", "numeric_value")


@query(
    "translator_age",
    with_views(
        f"""SELECT subject_id, printf('%.1f', floor((epoch_us(first_event) - epoch_us(birth)) / 86400000000) / 365.25) AS age FROM (
  SELECT subject_id, min(time) FILTER (code = 'MEDS_BIRTH') AS birth,
    min(time) FILTER (code IS NULL OR code <> 'MEDS_BIRTH') AS first_event FROM {ME} GROUP BY subject_id)""",
        ME,
    ),
)
def translator_age(f):
    from eventloom.operators.phrases import subject_ages

    return subject_ages(f.events()).select("subject_id", "age")


