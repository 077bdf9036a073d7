"""Whole runs of the shipped configurations, on the fixture tables.

Vocabularies are larger than the number of distinct strings here, so decoding a
run's timelines gives the strings known from the training split; those are compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import byte_pairs
from catalog.byte_pairs import checked
from catalog.events import AGES_SQL, BMI, GENDER, GENDER_SQL, MARITAL, MARITAL_SQL, ME, TRAIN, edges_sql
from catalog.events import BIN_SQL, ICU_ALLOWED, ICU_NOISE, WEIGHT_LABELS, bmi_edges_sql, subject_values_sql
from catalog.fixtures import with_views
from catalog.registry import ORACLES, joined, query, stage_path
from catalog.reports import LABEL_SQL, LONG, SAID, TERMS
from catalog.sequences import (
    INTERVAL_CONFIG,
    TOKEN_ORDER,
    cprd_gap_sql,
    gap_ctes,
    mimic_gap_sql,
    static_gap_sql,
    strings_sql,
)
from catalog.texts import PHRASES, SPLIT_TEXTS, VIEWS_USED
from catalog.vocabularies import ENCODED_SQL, EVENT_BPE_TIMELINES, VOCAB, VOCAB_SIZE, shown_timelines
from eventloom.plans.timelines import TimelineRun

PLAIN = {"insert_event_tokens": False, "insert_numeric_tokens": False, "insert_text_tokens": False}


def word_level(size: int = 5500) -> dict:
    return {"tokenizer": "word_level", "vocab_size": size, **PLAIN}


# ---- the main path

STANDARD = {
    "preprocessing": [
        {"type": "quantile_bin", "matching_type": "starts_with", "matching_value": "LAB", "k": 10, "value_column": "numeric_value"}
    ],
    "postprocessing": [{"type": "time_interval", "use_dynamic_bucketing": True, "interval_tokens": None, "dataset": "MIMIC"}],
}


@query("run_word_level", with_views(ENCODED_SQL, ME, **VOCAB))
def run_word_level(f):
    run = TimelineRun.from_config({**STANDARD, "tokenization": word_level(VOCAB_SIZE)})
    return shown_timelines(run.run(f.events()))


@query("run_saved", with_views(ENCODED_SQL, ME, **VOCAB))
def run_saved(f):
    """A run that is saved, loaded again and then encodes."""
    from catalog.registry import stage_path

    config = {**STANDARD, "tokenization": word_level(VOCAB_SIZE)}
    run, path = TimelineRun.from_config(config), stage_path(f, "run")
    run.train(run.fit(f.events()).tokens(f.events()))
    run.save(f.spark, path)
    loaded = TimelineRun.load(f.spark, config, path)
    return shown_timelines(loaded.encode(loaded.tokens(f.events())))


@query("run_bpe", checked(byte_pairs.timelines("spelled", TOKEN_ORDER), ME, **EVENT_BPE_TIMELINES))
def run_bpe(f):
    run = TimelineRun.from_config({**STANDARD, "tokenization": {"tokenizer": "bpe", "vocab_size": 110, **PLAIN}})
    return shown_timelines(run.run(f.events()))


@query(
    "run_text_bpe",
    checked(byte_pairs.POSITIONED, *VIEWS_USED, **PHRASES, **byte_pairs.text_learning(SPLIT_TEXTS, "text_sequence_with_time", 90), **byte_pairs.SPELLED),
)
def run_text_bpe(f):
    """Translate, learn a text vocabulary, encode: the text job over shards of every split."""
    from eventloom.operators.phrases import EventPhrases
    from eventloom.plans.text_job import run_text_job
    from eventloom.plans.text_vocab import vocab_folder
    from eventloom.sources.events import EVENT_SPLITS
    from eventloom.sources.sinks import write_shards

    folder = stage_path(f, "text-job")
    shards, texts, vocabularies, encoded = (f"{folder}/{name}" for name in ("events", "texts", "vocabularies", "encoded"))
    splits = list(EVENT_SPLITS)
    write_shards(f.events(), shards)
    config = {
        "translation": {"meds_root": shards, "output_root": texts, "splits": splits},
        "bpe_training": {"data_root": texts, "output_dir": vocabularies, "vocab_sizes": [90]},
        "encoding": {"data_root": texts, "tokenizer_dir": vocab_folder(vocabularies, 90), "output_root": encoded, "splits": splits},
    }
    run_text_job(f.spark, config, EventPhrases(f.labitems(), f.icd(), f.icd()))
    rows = [f.spark.read.parquet(f"{encoded}/{split}").withColumn("split", F.lit(split)) for split in splits]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.select("subject_id", "split", joined("tokens"), joined("timestamps"))


@query(
    "run_narrative",
    with_views(
        "SELECT subject_id, text, label, cancer_date FROM labelled JOIN texts USING (subject_id)",
        *TERMS,
        "subject_labels",
        **LONG,
        **SAID,
        **LABEL_SQL,
    ),
)
def run_narrative(f):
    from eventloom.reports.narratives import narrative_dataset, narrative_phrases

    run = TimelineRun.from_config({**STANDARD, "tokenization": word_level(VOCAB_SIZE)})
    timelines = run.run(f.events())
    phrases = narrative_phrases(run.tokenizer.vocab, f.view("medical_terms"), f.view("lab_terms"))
    found = narrative_dataset(timelines, phrases, f.view("subject_labels"))
    return found.select("subject_id", "text", F.col("label").cast("bigint").alias("label"), "cancer_date")


# ---- configurations


def _static(f, *columns: dict) -> dict:
    return {"type": "load_static_data", "csv_filepath": f.static(), "subject_id_column": "subject_id", "columns": list(columns)}


REGION = {"column_name": "region", "code_template": "DEMOGRAPHICS//REGION", "value_prefix": "REGION//", "insert_code": False}
MARITAL_VALUE = {**MARITAL, "insert_code": False}


def _lab(kind: str, **options) -> dict:
    return {"type": kind, "matching_type": "starts_with", "matching_value": "LAB//", "value_column": "numeric_value", **options}


def decoded(f, config: dict, fit_mode: str = "joint"):
    run = TimelineRun.from_config(config, fit_mode)
    timelines = run.run(f.events())
    times = F.transform("timestamps", lambda t: F.round(t * 1e6).cast("bigint").cast("string"))
    return run.tokenizer.decode(timelines.withColumn("times", F.array_join(times, "|"))).select("subject_id", "text", "times")


def rank_sql(patterns: list[str]) -> str:
    def cases(column: str) -> str:
        return " ".join(f"WHEN starts_with({column}, '{p}') THEN {i}" for i, p in enumerate(patterns))

    return f"CASE {cases('text_value')} {cases('code')} ELSE {len(patterns)} END"


def run_sql(patterns: list[str], name_sql, token_sql: str, **ctes: str) -> str:
    """Statement for a run whose CTEs end in ``ev`` (all rows after the event operators)."""
    blocks = strings_sql("ranked_rows", "t NULLS FIRST, r, rt, rc, seq, slot")
    rank = rank_sql(patterns)
    return with_views(
        """SELECT subject_id, '<start> ' || string_agg(CASE WHEN k.token IS NULL THEN '<unknown>' ELSE k.token END, ' '
  ORDER BY t NULLS FIRST, r, rt, rc, seq, slot, part) || ' <end>' AS text, any_value(times) AS times
FROM spread LEFT JOIN (SELECT DISTINCT token FROM spread WHERE split = 'train') k USING (token)
JOIN strings USING (subject_id) GROUP BY subject_id""",
        ME,
        "static_subjects",
        "lookup_labitems",
        "lookup_icd",
        **ctes,
        **gap_ctes("ev", name_sql, token_sql),
        ranked_rows=f"""SELECT *, CASE WHEN t IS NULL THEN {rank} END AS r, CASE WHEN t IS NULL THEN coalesce(text_value, '') END AS rt,
          CASE WHEN t IS NULL THEN coalesce(code, '') END AS rc FROM gapped""",
        **blocks,
        spread="SELECT *, unnest(items) AS token, unnest(range(len(items))) AS part FROM pieces",
    )


STATIC_BASE = {
    "first_static": f"""SELECT subject_id, arg_min(gender, file_order) AS g, arg_min(marital, file_order) AS m, arg_min(region, file_order) AS r
      FROM (SELECT subject_id, file_order, {GENDER_SQL} AS gender, {MARITAL_SQL} AS marital, upper(trim(region)) AS region FROM static_subjects)
      GROUP BY subject_id""",
    "subjects": f"SELECT DISTINCT subject_id, split FROM {ME}",
}


def _row(source: str, seq: int, code: str, text: str, numeric: str = "NULL") -> str:
    return f"SELECT subject_id, split, NULL::TIMESTAMP AS time, NULL::BIGINT AS t, {code} AS code, {numeric} AS numeric_value, {text} AS text_value, NULL AS unit, {seq} AS seq FROM {source}"


def static_rows_sql(*kinds: str) -> str:
    made = {
        "gender": "'GENDER//' || coalesce(g, 'UNKNOWN')",
        "marital": "'MARITAL_STATUS//' || coalesce(m, 'MARITAL_STATUS_UNKNOWN')",
        "region": "'REGION//' || coalesce(r, 'UNKNOWN')",
    }
    source = "subjects LEFT JOIN first_static USING (subject_id)"
    return " UNION ALL ".join(_row(source, i - 1000000000, "'STATIC_DATA_NO_CODE'", made[k]) for i, k in enumerate(kinds))


EVENT_CELLS = "subject_id, split, time, epoch_us(time) AS t, {code} AS code, {numeric} AS numeric_value, text_value, unit, seq"

ETHOS_PATTERNS = ["BMI//", "GENDER//", "MARITAL_STATUS//", "AGE_T", "RACE//"]
BMI_TEXT = {"token_pattern": "BMI (kg/m2)", "value_column": "text_value", "aggregation": "median", "token_prefix": "BMI//"}
BMI_TEXT_VALUES = f"""SELECT subject_id, any_value(split) AS split, median(v) AS value FROM (
  SELECT subject_id, split, TRY_CAST(text_value AS DOUBLE) AS v FROM {ME} WHERE starts_with(code, 'BMI (kg/m2)')) WHERE v IS NOT NULL GROUP BY subject_id"""
AGE_DIGITS = {
    "ages": AGES_SQL,
    "digits": """SELECT subject_id, split, CAST(floor(s / 10) AS BIGINT) AS a, CAST(round_even(s - 10 * floor(s / 10), 0) AS BIGINT) AS b
      FROM (SELECT subject_id, split, least(age, 99.0) AS s FROM ages JOIN subjects USING (subject_id))""",
}


@query(
    "run_ethos_config",
    run_sql(
        ETHOS_PATTERNS,
        static_gap_sql,
        "'<time_interval_' || gap || '>'",
        **STATIC_BASE,
        **AGE_DIGITS,
        subject_values=BMI_TEXT_VALUES,
        bins=bmi_edges_sql(10),
        edges=edges_sql("numeric_value", "LAB", 10),
        events_now=f"""SELECT e.* REPLACE (CASE WHEN numeric_value IS NULL THEN NULL WHEN starts_with(e.code, 'LAB') AND edges IS NOT NULL
          THEN {BIN_SQL.format(v="numeric_value")} ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value)
          FROM {ME} e LEFT JOIN edges q ON e.code = q.code WHERE e.code <> 'BMI (kg/m2)'""",
        ev=f"""SELECT {EVENT_CELLS.format(code="code", numeric="numeric_value")} FROM events_now
          UNION ALL {static_rows_sql("gender", "marital")}
          UNION ALL {_row("subject_values, bins", -5, "'STATIC_DATA_NO_CODE'",
                          "'BMI//Q' || CAST(len(list_filter(edges, lambda e: e <= value)) + 1 AS VARCHAR)")}
          UNION ALL {_row("digits", -4, "'STATIC_DATA_NO_CODE'", "'AGE_T1//Q' || CAST(CASE WHEN b = 10 THEN a + 2 ELSE a + 1 END AS VARCHAR)")}
          UNION ALL {_row("digits", -3, "'STATIC_DATA_NO_CODE'", "'AGE_T2//Q' || CAST(CASE WHEN b = 10 THEN 1 ELSE b + 1 END AS VARCHAR)")}""",
    ),
)
def run_ethos_config(f):
    bins = [
        {"type": "quantile_bin", "matching_type": "starts_with", "matching_value": value, "value_column": column, "k": 10}
        for value, column in (
            ("LAB", "numeric_value"), ("BMI", "text_value"), ("Height", "text_value"), ("Weight", "text_value"),
            ("SUBJECT_FLUID_OUTPUT//Q//", "numeric_value"),
        )
    ]
    return decoded(
        f,
        {
            "preprocessing": [
                _static(f, GENDER, MARITAL_VALUE),
                {
                    "type": "demographic_aggregation",
                    "measurements": [{**BMI_TEXT, "num_bins": 10, "insert_code": False, "remove_original_tokens": True}],
                },
                {
                    "type": "ethos_quantile_age", "time_unit": "years", "num_quantiles": 10, "prefix": "AGE_",
                    "insert_t1_code": False, "insert_t2_code": False, "keep_meds_birth": True,
                },
                *bins,
            ],
            "postprocessing": [
                {"type": "demographic_sort_order", "token_patterns": ETHOS_PATTERNS},
                {"type": "time_interval", "interval_tokens": INTERVAL_CONFIG},
            ],
            "tokenization": word_level(5500),
        },
    )


CPRD_PATTERNS = ["AGE", "GENDER//", "ETHNICITY//", "REGION//", "MEDICAL//BMI", "LIFESTYLE//"]
SHORT_CODE = "array_to_string(list_slice(string_split(code, '//'), 1, 2), '//')"


def _cprd_rounding() -> list[dict]:
    values = ["LAB//", "LAB//", "MEDICAL//bmi", "MEDICAL//bp_diastolic", "MEDICAL//bp_systolic", "MEASUREMENT//"]
    return [{**_lab("round_numeric", decimals=1), "matching_value": value} for value in values]


@query(
    "run_cprd_config",
    run_sql(
        CPRD_PATTERNS,
        cprd_gap_sql,
        "gap",
        **STATIC_BASE,
        ages=AGES_SQL,
        subject_values=subject_values_sql("median"),
        events_now=f"""SELECT * REPLACE ({SHORT_CODE} AS code, CASE WHEN starts_with(code, 'LAB//') THEN printf('%.1f', numeric_value)
          ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value) FROM {ME} WHERE code NOT IN ('MEDICAL//bmi', 'MEDS_BIRTH')""",
        ev=f"""SELECT {EVENT_CELLS.format(code="code", numeric="numeric_value")} FROM events_now
          UNION ALL {static_rows_sql("gender", "region")}
          UNION ALL {_row("subject_values", -5, "'MEDICAL//BMI'", "printf('%.1f', value)")}
          UNION ALL {_row("(SELECT * FROM ages JOIN subjects USING (subject_id) WHERE age >= 0)", -4, "'AGE'", "NULL", "printf('%.0f', age)")}""",
    ),
)
def run_cprd_config(f):
    height = {**BMI, "aggregation": "median", "decimals": 1, "remove_original_tokens": True}
    return decoded(
        f,
        {
            "preprocessing": [
                {"type": "code_truncation", "matching_type": "contains", "matching_value": "//"},
                _static(f, GENDER, REGION),
                {
                    "type": "demographic_aggregation",
                    "measurements": [
                        {**height, "token_prefix": "MEDICAL//BMI"},
                        {**height, "token_pattern": "MEDICAL//height", "token_prefix": "MEDICAL//HEIGHT"},
                        {**height, "token_pattern": "MEDICAL//weight", "token_prefix": "MEDICAL//WEIGHT"},
                    ],
                },
                *_cprd_rounding(),
                {"type": "raw_age", "keep_meds_birth": False, "decimals": 0},
            ],
            "postprocessing": [
                {"type": "time_interval", "interval_tokens": None, "use_dynamic_bucketing": True, "wrap_token": False, "dataset": "CPRD"},
                {"type": "demographic_sort_order", "token_patterns": CPRD_PATTERNS},
            ],
            "tokenization": word_level(50_000),
        },
    )


@query(
    "run_cprd_binned_config",
    run_sql(
        CPRD_PATTERNS,
        static_gap_sql,
        "'<time_interval_' || gap || '>'",
        **STATIC_BASE,
        ages=AGES_SQL,
        subject_values=subject_values_sql("median"),
        bins=bmi_edges_sql(5),
        short=f"SELECT * REPLACE ({SHORT_CODE} AS code) FROM {ME} WHERE code IS NOT NULL",
        edges=edges_sql("numeric_value", "LAB//", 4, "short"),
        events_now="""SELECT e.* REPLACE (CASE WHEN numeric_value IS NULL THEN NULL WHEN starts_with(e.code, 'LAB//') AND edges IS NOT NULL THEN
            CASE WHEN numeric_value < edges[1] THEN 'low' WHEN numeric_value <= edges[3] THEN 'normal' ELSE 'high' END
          ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value) FROM short e LEFT JOIN edges q ON e.code = q.code
          WHERE e.code NOT IN ('MEDICAL//bmi', 'MEDS_BIRTH')""",
        ev=f"""SELECT {EVENT_CELLS.format(code="code", numeric="numeric_value")} FROM events_now
          UNION ALL {static_rows_sql("gender", "region")}
          UNION ALL {_row("subject_values, bins", -5, "'MEDICAL//BMI'", f"{WEIGHT_LABELS!r}[len(list_filter(edges, lambda e: e <= value)) + 1]")}
          UNION ALL {_row("(SELECT * FROM ages JOIN subjects USING (subject_id) WHERE age >= 20 AND age < 100)", -4,
                          "'AGE: ' || CAST(CAST(floor(age / 5) * 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(age / 5) * 5 AS BIGINT) + 4 AS VARCHAR)", "NULL")}""",
    ),
)
def run_cprd_binned_config(f):
    return decoded(
        f,
        {
            "preprocessing": [
                {"type": "code_truncation", "matching_type": "contains", "matching_value": "//"},
                _static(f, GENDER, REGION),
                {
                    "type": "demographic_aggregation",
                    "measurements": [
                        {
                            **BMI, "aggregation": "median", "num_bins": 5, "bin_labels": WEIGHT_LABELS,
                            "token_prefix": "MEDICAL//BMI", "remove_original_tokens": True,
                        }
                    ],
                },
                {"type": "binned_age", "keep_meds_birth": False},
                _lab("quantile_bin_3level"),
            ],
            "postprocessing": [
                {"type": "time_interval", "interval_tokens": INTERVAL_CONFIG},
                {"type": "demographic_sort_order", "token_patterns": CPRD_PATTERNS},
            ],
            "tokenization": word_level(20_000),
        },
    )


MIMIC_PATTERNS = ["AGE", "BMI", "GENDER//", "RACE//", "MARITAL_STATUS//"]


@query(
    "run_mimic_config",
    run_sql(
        MIMIC_PATTERNS,
        mimic_gap_sql,
        "gap",
        **STATIC_BASE,
        top=f"""SELECT code FROM {ME} WHERE {TRAIN} AND starts_with(code, 'LAB//') GROUP BY code ORDER BY count(*) DESC, code LIMIT 10""",
        kept=f"""SELECT * FROM {ME} WHERE NOT contains(code, '//22') AND regexp_matches(code, '{ICU_ALLOWED}')""",
        subject_values=BMI_TEXT_VALUES.replace(f"FROM {ME}", "FROM kept"),
        kept2="""SELECT * FROM kept WHERE code <> 'BMI (kg/m2)' AND (NOT starts_with(code, 'LAB//') OR code IN (SELECT code FROM top))""",
        ages=AGES_SQL.replace(f"FROM {ME}", "FROM kept2"),
        events_now="""SELECT * REPLACE (CASE WHEN starts_with(code, 'LAB//') THEN printf('%.1f', numeric_value)
          ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value) FROM kept2 WHERE code <> 'MEDS_BIRTH'""",
        ev=f"""SELECT {EVENT_CELLS.format(code="code", numeric="numeric_value")} FROM events_now
          UNION ALL {static_rows_sql("gender", "marital")}
          UNION ALL {_row("subject_values", -5, "'BMI'", "printf('%.1f', value)")}
          UNION ALL {_row("(SELECT * FROM ages JOIN subjects USING (subject_id) WHERE age >= 0)", -4, "'AGE'", "NULL", "CAST(round_even(age, 0) AS VARCHAR)")}""",
    ),
)
def run_mimic_config(f):
    filters = [{"type": "filter", "matching_type": kind, "matching_value": value} for kind, value in ICU_NOISE]
    return decoded(
        f,
        {
            "preprocessing": [
                *filters,
                {"type": "filter", "matching_type": "regex", "matching_value": ICU_ALLOWED, "invert": "true"},
                {
                    "type": "demographic_aggregation",
                    "measurements": [{**BMI_TEXT, "decimals": 1, "insert_code": True, "remove_original_tokens": True}],
                },
                {"type": "top_k_filter", "matching_type": "starts_with", "matching_value": "LAB//", "k": 10},
                {"type": "raw_age", "keep_meds_birth": False, "decimals": 0},
                _static(f, GENDER, MARITAL_VALUE),
                _lab("round_numeric", decimals=1),
                {"type": "raw_age", "keep_meds_birth": False, "decimals": 0},
            ],
            "postprocessing": [
                {"type": "time_interval", "interval_tokens": None, "use_dynamic_bucketing": True, "wrap_token": False, "dataset": "MIMIC"},
                {"type": "demographic_sort_order", "token_patterns": MIMIC_PATTERNS},
            ],
            "tokenization": word_level(50_000),
        },
    )


@query(
    "run_enrich_config",
    run_sql(
        ["GENDER//"],
        static_gap_sql,
        "'<time_interval_' || gap || '>'",
        enriched=f"""SELECT e.* REPLACE (CASE
            WHEN starts_with(code, 'LAB//') AND l.itemid IS NOT NULL
              THEN '<LAB> ' || CAST(l.itemid AS VARCHAR) || ' ' || l.label || ' (' || l.category || ') </LAB>'
            WHEN starts_with(code, 'DIAGNOSIS//ICD//10//') AND i.icd_code IS NOT NULL THEN '<DX> ' || i.long_title || ' </DX>'
            ELSE code END AS code), code AS old_code
          FROM {ME} e LEFT JOIN lookup_labitems l ON starts_with(code, 'LAB//') AND TRY_CAST(string_split(code, '//')[2] AS BIGINT) = l.itemid
          LEFT JOIN (SELECT * FROM lookup_icd WHERE icd_version = 10) i ON string_split(code, '//')[4] = i.icd_code""",
        edges=edges_sql("numeric_value", "LAB", 10, "enriched"),
        ev=f"""SELECT subject_id, split, time, epoch_us(time) AS t, e.code, CASE WHEN numeric_value IS NULL THEN NULL
            WHEN starts_with(old_code, 'LAB') AND edges IS NOT NULL THEN {BIN_SQL.format(v="numeric_value")}
            ELSE CAST(numeric_value AS VARCHAR) END AS numeric_value, text_value, unit, seq
          FROM enriched e LEFT JOIN edges q ON old_code = q.code""",
    ),
)
def run_enrich_config(f):
    """Bins listed before the enrichment: enriched codes are fitted, so found codes stay unbinned."""
    return decoded(
        f,
        {
            "preprocessing": [
                {"type": "quantile_bin", "matching_type": "starts_with", "matching_value": "LAB", "value_column": "numeric_value", "k": 10},
                {
                    "type": "code_enrichment", "matching_type": "starts_with", "matching_value": "LAB//", "lookup_file": f.labitems(),
                    "template": "<LAB> {itemid} {label} ({category}) </LAB>", "code_column": "itemid",
                },
                {
                    "type": "code_enrichment", "matching_type": "starts_with", "matching_value": "DIAGNOSIS//ICD//10//",
                    "lookup_file": f.icd(), "template": "<DX> {long_title} </DX>", "code_column": "icd_code",
                    "dtypes": {"icd_code": "string"}, "additional_filters": {"icd_version": 10},
                },
            ],
            "postprocessing": [
                {"type": "time_interval", "interval_tokens": INTERVAL_CONFIG},
                {"type": "demographic_sort_order", "token_patterns": ["GENDER//"]},
            ],
            "tokenization": word_level(5500),
        },
    )


# ---- arriving shards


@query("stream_subjects", with_views(ENCODED_SQL, ME, **VOCAB))
def stream_subjects(f):
    """The main path over shards that arrive by time, subjects spread over all of them."""
    from eventloom.streaming.subjects import encode_arriving, timelines

    events = f.events()
    run = TimelineRun.from_config({**STANDARD, "tokenization": word_level(VOCAB_SIZE)})
    run.train(run.fit(events).tokens(events))
    folder = stage_path(f, "stream")
    shards, output, checkpoint = (f"{folder}/{name}" for name in ("shards", "output", "checkpoint"))
    arriving = events.drop("split")
    edges = [F.lit(e) for e in arriving.agg(F.percentile_approx("time", [0.3, 0.7])).first()[0]]
    first = F.col("time").isNull() | (F.col("time") < edges[0])
    for part in (first, ~first & (F.col("time") < edges[1]), ~first & (F.col("time") >= edges[1])):
        arriving.where(part).write.mode("append").parquet(shards)
        encode_arriving(f.spark, run, shards, arriving.schema, output, checkpoint).awaitTermination()
    return shown_timelines(timelines(f.spark, run, output).join(events.select("subject_id", "split").distinct(), "subject_id"))


# ---- counts kept per shard


def _in_two_parts(f, counted, by: str = "subject_id"):
    """Merged counts after two updates, with half of the subjects in shards that came later."""
    from eventloom.plans.shard_counts import ShardCounts

    folder = stage_path(f, "shard-counts")
    store = ShardCounts(f.spark, f"{folder}/shards", f"{folder}/counts", counted)
    train = f.events().where(TRAIN)
    for part in (0, 1):
        train.where(F.pmod(by, F.lit(2)) == part).repartition(3, by).write.mode("append").parquet(f"{folder}/shards")
        store.update()
    return store.merged()


@query("counts_by_shard", ORACLES["agg_code_counts"])
def counts_by_shard(f):
    from eventloom.plans.shard_counts import codes

    return _in_two_parts(f, codes)


@query("fit_by_shard", ORACLES["fit_jointly"])
def fit_by_shard(f):
    """The joint fit from counts per shard."""
    from catalog.events import jointly_fitted, shown_joint_edges
    from eventloom.plans.shard_counts import fit_values, values_of

    ops = jointly_fitted()
    fit_values(ops, _in_two_parts(f, values_of(ops)))
    return shown_joint_edges(ops)


@query("vocab_by_shard", ORACLES["word_vocab_train"])
def vocab_by_shard(f):
    """The vocabulary of the main path from token counts per shard."""
    from eventloom.operators.word_vocab import WordLevel
    from eventloom.plans.shard_counts import tokens_of

    run = TimelineRun.from_config({**STANDARD, "tokenization": word_level(VOCAB_SIZE)}).fit(f.events())
    counts = _in_two_parts(f, tokens_of(run)).withColumnRenamed("n", "count")
    return WordLevel(VOCAB_SIZE).train_counts(counts).vocab
