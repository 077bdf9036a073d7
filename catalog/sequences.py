"""Operators over ordered events, and the strings they become."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.events import BIN_SQL, ME, TRAIN, edges_sql
from catalog.fixtures import with_views
from catalog.registry import query
from eventloom.operators.sequence import (
    DemographicSortOrder,
    NaturalLanguageTranslation,
    RemoveNumeric,
    TimeIntervals,
    build_sequence,
)
from eventloom.operators.static import LoadStaticData
from eventloom.operators.tokens import Markers, string_sequences, token_rows
from eventloom.operators.values import QuantileBin, QuantileBin3Level
from eventloom.ordering import Ordered, running_total
from eventloom.schema import epoch_seconds

# Minute ranges of the shipped interval configuration.
INTERVALS = {
    "5m-15m": (5, 15), "15m-45m": (15, 45), "45m-1h15m": (45, 75), "1h15m-2h": (75, 120), "2h-3h": (120, 180),
    "3h-5h": (180, 300), "5h-8h": (300, 480), "8h-12h": (480, 720), "12h-18h": (720, 1080), "18h-1d": (1080, 1440),
    "1d-2d": (1440, 2880), "2d-4d": (2880, 5760), "4d-7d": (5760, 10080), "7d-12d": (10080, 17280),
    "12d-20d": (17280, 28800), "20d-30d": (28800, 43200), "30d-2mt": (43200, 86400), "2mt-6mt": (86400, 259200),
    "6mt-": (259200, None),
}
INTERVAL_CONFIG = {
    name: ({"min": low} if high is None else {"min": low, "max": high}) for name, (low, high) in INTERVALS.items()
}

# ---- SQL building blocks


def text_events_sql(source: str = ME) -> str:
    return f"""SELECT subject_id, split, time, epoch_us(time) AS t, code, CAST(numeric_value AS VARCHAR) AS numeric_value,
      text_value, unit, seq FROM {source}"""


def static_gap_sql(gap: str) -> str:
    cases = " ".join(
        f"WHEN {gap} >= {low * 60_000_000}"
        + (f" AND {gap} <= {high * 60_000_000}" if high is not None else "")
        + f" THEN '{name}'"
        for name, (low, high) in INTERVALS.items()
    )
    return f"CASE {cases} END"


def _plural(number: str, unit: str) -> str:
    return f"CAST({number} AS VARCHAR) || CASE WHEN {number} = 1 THEN ' {unit}' ELSE ' {unit}s' END"


def mimic_gap_sql(gap: str) -> str:
    return f"""CASE WHEN {gap} IS NULL OR {gap} < 300000000 THEN NULL
      WHEN {gap} < 3600000000 THEN {_plural(f"({gap} // 60000000)", "minute")}
      WHEN {gap} < 86400000000 THEN {_plural(f"({gap} // 3600000000)", "hour")}
      WHEN {gap} < 604800000000 THEN {_plural(f"({gap} // 86400000000)", "day")}
      ELSE {_plural(f"({gap} // 604800000000)", "week")} END"""


def cprd_gap_sql(gap: str) -> str:
    days = f"CAST(least(greatest(round_even({gap} / 86400000000.0, 0), 1), 6) AS BIGINT)"
    weeks = f"CAST(round_even({gap} / 86400000000.0 / 7, 0) AS BIGINT)"
    return f"""CASE WHEN {gap} IS NULL OR {gap} < 86400000000 THEN NULL
      WHEN {gap} < 604800000000 THEN {_plural(days, "day")} ELSE {_plural(weeks, "week")} END"""


BEFORE = "OVER (PARTITION BY subject_id ORDER BY time NULLS FIRST, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def gap_ctes(source: str, name_sql, token_sql: str) -> dict[str, str]:
    """CTEs that end in ``gapped``: events and gap tokens with a ``slot``."""
    return {
        "seen1": f"SELECT *, max(CASE WHEN code IS DISTINCT FROM 'MEDS_BIRTH' THEN t END) {BEFORE} AS p1 FROM {source}",
        "seen2": f"""SELECT *, max(CASE WHEN code IS DISTINCT FROM 'MEDS_BIRTH' OR ({name_sql("(t - p1)")}) IS NOT NULL
          THEN t END) {BEFORE} AS p2 FROM seen1""",
        "named": f"SELECT *, {name_sql('(t - p2)')} AS gap FROM seen2",
        "gapped": f"""SELECT subject_id, split, time, t, seq, 1 AS slot, code, numeric_value, text_value, unit FROM named
          UNION ALL SELECT subject_id, split, time, t, seq, 0, {token_sql}, NULL, NULL, NULL FROM named WHERE gap IS NOT NULL""",
    }


POSITION_SQL = "row_number() OVER (PARTITION BY subject_id ORDER BY time NULLS FIRST, seq, slot) AS pos"


def with_positions(rows: Ordered):
    return running_total(rows, F.lit(1), "pos").df


# ---- order and gaps


@query(
    "build_sequence",
    with_views(
        f"""SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY time NULLS FIRST, seq) AS pos, code,
CAST(numeric_value AS VARCHAR) AS numeric_value, text_value FROM {ME}""",
        ME,
    ),
)
def build(f):
    df = with_positions(build_sequence(f.events()))
    return df.select("subject_id", "pos", "code", "numeric_value", "text_value")


def _gap_query(name: str, operator: TimeIntervals, name_sql, token_sql: str) -> None:
    oracle = with_views(
        f"SELECT subject_id, {POSITION_SQL}, code, numeric_value FROM gapped",
        ME,
        ev=text_events_sql(),
        **gap_ctes("ev", name_sql, token_sql),
    )

    @query(name, oracle)
    def gaps(f):
        df = with_positions(operator.apply(build_sequence(f.events())))
        return df.select("subject_id", "pos", "code", "numeric_value")


WRAPPED = "'<time_interval_' || gap || '>'"
_gap_query("time_interval_static", TimeIntervals(INTERVAL_CONFIG), static_gap_sql, WRAPPED)
_gap_query(
    "time_interval_dynamic_mimic", TimeIntervals(None, True, True, "MIMIC"), mimic_gap_sql, WRAPPED
)
_gap_query("time_interval_dynamic_cprd", TimeIntervals(None, True, False), cprd_gap_sql, "gap")
_gap_query(
    "time_token_wrap", TimeIntervals(None, True, False, "MIMIC", "TIME "), mimic_gap_sql, "'TIME ' || gap"
)


# ---- untimed rows first, in pattern order

SORT_PATTERNS = ["REGION//", "GENDER//", "MARITAL"]
SORT_COLUMNS = [
    {"column_name": "gender", "code_template": "DEMOGRAPHICS//GENDER", "value_prefix": "GENDER//", "insert_code": False},
    {"column_name": "marital_status", "code_template": "MARITAL_STATUS", "insert_code": True},
    {"column_name": "region", "code_template": "DEMOGRAPHICS//REGION", "value_prefix": "REGION//", "insert_code": False},
]
SORTED_STATIC = {
    "first_static": """SELECT subject_id, arg_min(coalesce(upper(trim(gender)), 'UNKNOWN'), file_order) AS g,
      arg_min(upper(trim(marital_status)), file_order) AS m, arg_min(upper(trim(region)), file_order) AS r
      FROM static_subjects GROUP BY subject_id""",
    "static_rows": f"""SELECT subject_id, split, NULL::BIGINT AS t, c.code,
      c.prefix || coalesce(CASE c.i WHEN 0 THEN g WHEN 1 THEN m ELSE r END, 'UNKNOWN') AS text_value, c.i - 1000000000 AS seq
      FROM (SELECT DISTINCT subject_id, split FROM {ME}) LEFT JOIN first_static USING (subject_id),
      (VALUES (0, 'STATIC_DATA_NO_CODE', 'GENDER//'), (1, 'MARITAL_STATUS', ''), (2, 'STATIC_DATA_NO_CODE', 'REGION//')) c(i, code, prefix)""",
    "all_rows": f"""SELECT subject_id, t, code, text_value, seq FROM static_rows
      UNION ALL SELECT subject_id, epoch_us(time), code, text_value, seq FROM {ME}""",
}


def with_static(f):
    return LoadStaticData(f.static(), "subject_id", SORT_COLUMNS).fit_transform(f.events())


@query(
    "demographic_sort_order",
    with_views(
        """
SELECT subject_id, code, text_value, row_number() OVER (PARTITION BY subject_id ORDER BY t NULLS FIRST,
  CASE WHEN t IS NULL THEN CASE
    WHEN starts_with(text_value, 'REGION//') THEN 0 WHEN starts_with(text_value, 'GENDER//') THEN 1
    WHEN starts_with(text_value, 'MARITAL') THEN 2 WHEN starts_with(code, 'REGION//') THEN 0
    WHEN starts_with(code, 'GENDER//') THEN 1 WHEN starts_with(code, 'MARITAL') THEN 2 ELSE 3 END END,
  CASE WHEN t IS NULL THEN coalesce(text_value, '') END, CASE WHEN t IS NULL THEN coalesce(code, '') END, seq) AS pos
FROM all_rows""",
        ME,
        "static_subjects",
        **SORTED_STATIC,
    ),
)
def demographic_sort_order(f):
    rows = DemographicSortOrder(SORT_PATTERNS).apply(build_sequence(with_static(f)))
    return with_positions(rows).select("subject_id", "code", "text_value", "pos")


@query(
    "remove_numeric",
    with_views(
        r"""
SELECT subject_id, seq, code, numeric_value, text_value FROM ev
WHERE NOT coalesce(regexp_full_match(trim(numeric_value), '-?\d+\.?\d*'), FALSE)
  AND NOT coalesce(regexp_full_match(trim(text_value), '-?\d+\.?\d*'), FALSE)""",
        ME,
        ev=text_events_sql(),
    ),
)
def remove_numeric(f):
    rows = RemoveNumeric().apply(build_sequence(f.events()))
    return rows.df.select("subject_id", "seq", "code", "numeric_value", "text_value")


# ---- strings


def strings_sql(source: str, order: str, markers: Markers = Markers(False, False, False)) -> dict[str, str]:
    """CTEs ending in ``strings``: joined strings and times of every subject in ``source``."""

    def wrapped(column: str, name: str, on: bool) -> str:
        if not on:
            return column
        mark = f"CASE WHEN {column} IS NOT NULL THEN '<{name}>' END"
        return f"{mark}, {column}, {mark.replace('<' + name, '</' + name)}"

    cells = ", ".join(
        [
            "CASE WHEN code <> 'STATIC_DATA_NO_CODE' THEN code END",
            wrapped("numeric_value", "numeric", markers.numeric),
            wrapped("text_value", "text", markers.text),
            "unit",
        ]
    )
    if markers.event:
        cells = f"'<event>', {cells}, '</event>'"
    return {
        "pieces": f"SELECT *, list_filter([{cells}], lambda x: x IS NOT NULL) AS items FROM {source}",
        "strings": f"""SELECT subject_id,
          '<start>|' || coalesce(string_agg(array_to_string(items, '|'), '|' ORDER BY {order}) FILTER (len(items) > 0) || '|', '') || '<end>' AS strings,
          '0|' || coalesce(string_agg(array_to_string(list_transform(items, lambda x: CAST(coalesce(t, 0) AS VARCHAR)), '|'), '|' ORDER BY {order})
            FILTER (len(items) > 0) || '|', '') || CAST(coalesce(max(t), 0) AS VARCHAR) AS times
          FROM pieces GROUP BY subject_id""",
    }


def shown_strings(rows: Ordered, markers: Markers):
    df = string_sequences(token_rows(rows, markers))
    return df.select(
        "subject_id",
        F.array_join("strings", "|").alias("strings"),
        F.array_join(
            F.transform("timestamps", lambda t: F.round(t * 1e6).cast("bigint").cast("string")), "|"
        ).alias("times"),
    )


def _strings_query(name: str, markers: Markers) -> None:
    oracle = with_views(
        "SELECT subject_id, strings, times FROM strings",
        ME,
        ev=text_events_sql(),
        **strings_sql("ev", "time NULLS FIRST, seq", markers),
    )

    @query(name, oracle)
    def strings(f):
        return shown_strings(build_sequence(f.events()), markers)


_strings_query("to_token_strings", Markers(False, False, False))
_strings_query("event_markers", Markers(True, False, False))
_strings_query("numeric_markers", Markers(False, True, False))
_strings_query("text_markers", Markers(False, False, True))


@query(
    "suppress_placeholder",
    with_views(
        "SELECT subject_id, strings FROM strings",
        ME,
        "static_subjects",
        **SORTED_STATIC,
        flat=f"""SELECT subject_id, time, t, code, numeric_value, text_value, unit, seq FROM ({text_events_sql()})
          UNION ALL SELECT subject_id, NULL, t, code, NULL, text_value, NULL, seq FROM static_rows""",
        **strings_sql("flat", "time NULLS FIRST, seq"),
    ),
)
def suppress_placeholder(f):
    return shown_strings(build_sequence(with_static(f)), Markers(False, False, False)).select("subject_id", "strings")


@query(
    "token_timestamps",
    with_views(f"SELECT subject_id, seq, coalesce(epoch_us(time), 0) AS ts_us FROM {ME}", ME),
)
def token_timestamps(f):
    ts = F.round(epoch_seconds() * 1e6).cast("bigint")
    return f.events().select("subject_id", "seq", ts.alias("ts_us"))


# ---- natural language

NL_CASES = r"""CASE
  WHEN starts_with(code, 'MEDICAL//BMI') THEN string_split(code, '//')[2] || CASE WHEN label IS NOT NULL THEN ' ' || label ELSE '' END
  WHEN starts_with(code, 'MEDICAL//') THEN coalesce(term, titled)
  WHEN starts_with(code, 'LAB//') THEN CASE WHEN label IN ('low', 'normal', 'high')
    THEN '<EVT> ' || coalesce(term, titled) || ' ' || label ELSE coalesce(term, titled) END
  ELSE code END"""

LEVEL_EVENTS = {
    "edges": edges_sql("numeric_value", "LAB//", 4),
    "levels": f"""SELECT subject_id, seq, e.code, e.text_value, CASE WHEN numeric_value IS NULL THEN NULL
      WHEN starts_with(e.code, 'LAB//') AND edges IS NOT NULL THEN
        CASE WHEN numeric_value < edges[1] THEN 'low' WHEN numeric_value <= edges[3] THEN 'normal' ELSE 'high' END
      ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value, time FROM {ME} e LEFT JOIN edges q ON e.code = q.code""",
    "terms": """SELECT 'M' || upper(code) AS key, arg_max(term, file_order) AS term FROM medical_terms GROUP BY 1
      UNION ALL SELECT 'L' || upper(code), arg_max(term, file_order) FROM lab_terms GROUP BY 1""",
}
TITLED = """array_to_string(list_transform(regexp_extract_all(replace(upper(string_split(code, '//')[2]), '_', ' '), '[A-Za-z]+|[^A-Za-z]+'),
  lambda w: upper(w[1]) || lower(w[2:])), '')"""


def levelled(f):
    events = f.events()
    op = QuantileBin3Level("starts_with", "LAB//", "numeric_value").fit(events.where(TRAIN))
    return op.transform(events)


def translator(f, bin_source: str) -> NaturalLanguageTranslation:
    return NaturalLanguageTranslation(
        f.view("medical_terms"), f.view("medical_terms"), f.view("lab_terms"), f.view("region_terms"), bin_source
    )


TERM_JOIN = """LEFT JOIN terms ON key = CASE WHEN starts_with(code, 'LAB//') THEN 'L'
  WHEN starts_with(code, 'MEDICAL//') OR starts_with(code, 'MEASUREMENT//') THEN 'M' END || upper(string_split(code, '//')[2])"""


@query(
    "natural_language_translation",
    with_views(
        f"SELECT subject_id, seq, {NL_CASES} AS code, numeric_value FROM labelled WHERE code IS NOT NULL",
        ME,
        "medical_terms",
        "lab_terms",
        **LEVEL_EVENTS,
        labelled=f"""SELECT l.*, term, {TITLED} AS titled,
          CASE WHEN starts_with(code, 'LAB//') AND numeric_value IN ('low', 'normal', 'high') THEN numeric_value END AS label
          FROM levels l {TERM_JOIN}""",
    ),
)
def natural_language_translation(f):
    rows = translator(f, "value").apply(build_sequence(levelled(f)))
    return rows.df.select("subject_id", "seq", "code", "numeric_value")


LABEL_ROWS = """CASE WHEN seq % 3 = 0 THEN ['low', 'normal', 'high', 'very low', 'very high'][1 + CAST(seq // 3 % 5 AS INT)] ELSE code END"""


@query(
    "natural_language_next_code",
    with_views(
        f"""SELECT subject_id, seq, {NL_CASES} AS code FROM labelled
WHERE code NOT IN ('low', 'normal', 'high', 'very low', 'very high')""",
        ME,
        "medical_terms",
        "lab_terms",
        terms=LEVEL_EVENTS["terms"],
        mixed=f"SELECT * REPLACE ({LABEL_ROWS} AS code) FROM {ME}",
        looked=f"""SELECT *, lead(code) OVER (PARTITION BY subject_id ORDER BY time NULLS FIRST, seq) AS next_code FROM mixed""",
        labelled=f"""SELECT l.*, term, {TITLED} AS titled, CASE WHEN starts_with(code, 'LAB//') AND
          next_code IN ('low', 'normal', 'high', 'very low', 'very high') THEN next_code END AS label
          FROM looked l {TERM_JOIN}""",
    ),
)
def natural_language_next_code(f):
    labels = F.array(*[F.lit(x) for x in ("low", "normal", "high", "very low", "very high")])
    picked = F.get(labels, F.pmod(F.floor(F.col("seq") / 3), F.lit(5)).cast("int"))
    mixed = f.events().withColumn("code", F.when(F.pmod("seq", F.lit(3)) == 0, picked).otherwise(F.col("code")))
    rows = translator(f, "next_code").apply(build_sequence(mixed))
    return rows.df.select("subject_id", "seq", "code")


# ---- the standard chain: binned labs, gaps, strings

BINNED = {
    "edges": edges_sql("numeric_value", "LAB", 10),
    "ev": f"""SELECT subject_id, split, time, epoch_us(time) AS t, e.code, CASE WHEN numeric_value IS NULL THEN NULL
      WHEN starts_with(e.code, 'LAB') AND edges IS NOT NULL THEN {BIN_SQL.format(v="numeric_value")}
      ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value, text_value, unit, seq
      FROM {ME} e LEFT JOIN edges q ON e.code = q.code""",
    **gap_ctes("ev", mimic_gap_sql, WRAPPED),
}
TOKENS = {
    **BINNED,
    "listed": """SELECT subject_id, split, time, t, seq, slot,
      list_filter([code, numeric_value, text_value, unit], lambda x: x IS NOT NULL) AS items FROM gapped""",
    "toks": """SELECT subject_id, split, time, t, seq, slot, unnest(items) AS token, unnest(range(len(items))) AS part FROM listed""",
}
TOKEN_ORDER = "time NULLS FIRST, seq, slot, part"
NO_MARKERS = Markers(False, False, False)


def standard_tokens(f) -> Ordered:
    events = f.events()
    op = QuantileBin("starts_with", "LAB", 10, "numeric_value").fit(events.where(TRAIN))
    rows = TimeIntervals(None, True, True, "MIMIC").apply(build_sequence(op.transform(events), events))
    return token_rows(rows, NO_MARKERS)
