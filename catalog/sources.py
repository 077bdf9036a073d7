"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import with_views
from catalog.registry import EVENT, EVENT_SQL, query, shown, stage_path
from eventloom.operators.sequence import term_lookup
from eventloom.operators.phrases import phrase_lookup
from eventloom.operators.codes import render
from eventloom.sources import events as readers
from eventloom.sources import sinks
from eventloom.sources.tables import read_table


@query("scan_splits", with_views(f"SELECT split, {EVENT_SQL} FROM meds_events", "meds_events"))
def scan_splits(f):
    path = stage_path(f, "events")
    sinks.write_shards(f.events(), path)
    return shown(readers.read_events(f.spark, path), "split", *EVENT)


def _staged_texts(f):
    plain = stage_path(f, "text-splits")
    rows = f.view("text_rows")
    for split in readers.TEXT_SPLITS:
        readers.in_splits(rows, [split]).drop("split").write.parquet(f"{plain}/{split}")
    return plain


@query(
    "scan_two_split",
    with_views("SELECT split, subject_id, text_sequence_with_time FROM text_rows", "text_rows"),
)
def scan_two_split(f):
    return readers.read_text_splits(f.spark, _staged_texts(f)).select("split", "subject_id", "text_sequence_with_time")


@query(
    "scan_text_column",
    with_views(
        "SELECT text_sequence_with_time FROM text_rows WHERE text_sequence_with_time <> ''", "text_rows"
    ),
)
def scan_text_column(f):
    return readers.text_column(f.view("text_rows"), "text_sequence_with_time")


@query("scan_projected", with_views("SELECT subject_id, text_sequence_with_time FROM text_rows", "text_rows"))
def scan_projected(f):
    return f.view("text_rows").select("subject_id", "text_sequence_with_time")


# Chosen splits only, all of their rows.
@query(
    "scan_caps",
    with_views(
        "SELECT subject_id, split, text_sequence_with_time FROM text_rows WHERE split IN ('test')",
        "text_rows",
    ),
)
def scan_caps(f):
    rows = readers.in_splits(f.view("text_rows"), ["test"])
    return rows.select("subject_id", "split", "text_sequence_with_time")


def _csv(f, df, name: str) -> str:
    path = stage_path(f, name)
    df.write.csv(path, header=True, compression="gzip")
    return path


@query(
    "csv_static",
    with_views(
        "SELECT subject_id, file_order, gender, marital_status, region FROM static_subjects", "static_subjects"
    ),
)
def csv_static(f):
    path = stage_path(f, "static")
    f.static().write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    table = read_table(f.spark, path)
    return table.select(F.col("subject_id").cast("bigint"), "file_order", "gender", "marital_status", "region")


@query(
    "csv_lookup_typed",
    with_views(
        "SELECT icd_code, CAST(icd_version AS VARCHAR) AS icd_version, long_title FROM lookup_icd WHERE icd_version = 10",
        "lookup_icd",
    ),
)
def csv_lookup_typed(f):
    path = _csv(f, f.view("lookup_icd"), "icd")
    table = read_table(f.spark, path, {"icd_version": "string", "icd_code": "str"})
    return table.where(F.col("icd_version") == "10").select("icd_code", "icd_version", "long_title")


@query(
    "csv_term_lookup",
    with_views(
        "SELECT upper(code) AS code, arg_max(term, file_order) AS term FROM medical_terms GROUP BY upper(code)",
        "medical_terms",
    ),
)
def csv_term_lookup(f):
    return term_lookup(read_table(f.spark, f.view("medical_terms")))


@query(
    "csv_icd_lookup",
    with_views(
        """
SELECT 'L' || CAST(itemid AS VARCHAR) AS key, label AS name FROM lookup_labitems
UNION ALL SELECT 'D' || CAST(icd_version AS VARCHAR) || '_' || icd_code, long_title FROM lookup_icd
UNION ALL SELECT 'P' || CAST(icd_version AS VARCHAR) || '_' || icd_code, long_title FROM lookup_icd
""",
        "lookup_labitems",
        "lookup_icd",
    ),
)
def csv_icd_lookup(f):
    labs = read_table(f.spark, _csv(f, f.labitems(), "labs"), {"itemid": "int"})
    icd = read_table(f.spark, _csv(f, f.view("lookup_icd"), "icd"), {"icd_code": "string", "icd_version": "string"})
    return phrase_lookup(labs, icd, icd)


@query(
    "csv_vocab",
    """
WITH v AS (
  SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) + 2 AS INTEGER) AS token, p_type AS str, count(*) AS count
  FROM part GROUP BY p_type)
SELECT token, str, count FROM v
UNION ALL SELECT 0, '<unknown>', 0 UNION ALL SELECT 1, '<start>', 0 UNION ALL SELECT 2, '<end>', 0
""",
)
def csv_vocab(f):
    from eventloom.operators.word_vocab import token_counts, vocabulary

    vocab = vocabulary(token_counts(f.table("part").select(F.col("p_type").alias("token"))), 100_000)
    path = stage_path(f, "vocab")
    sinks.write_vocab(vocab, path)
    return readers.read_vocab(f.spark, path)


@query(
    "csv_labels",
    with_views(
        "SELECT subject_id, is_case, site, epoch_us(TRY_CAST(cancerdate AS TIMESTAMP)) AS cancer_us FROM subject_labels",
        "subject_labels",
    ),
)
def csv_labels(f):
    labels = readers.read_labels(f.spark, _csv(f, f.view("subject_labels"), "labels"))
    return labels.select("subject_id", "is_case", "site", F.unix_micros("cancerdate").alias("cancer_us"))


@query(
    "template_render",
    with_views(
        "SELECT '<LAB> ' || CAST(itemid AS VARCHAR) || ' ' || label || ' (' || category || ') </LAB>' AS text FROM lookup_labitems",
        "lookup_labitems",
    ),
)
def template_render(f):
    labs = f.labitems()
    kinds = {c.name: c.dataType for c in labs.schema}
    return labs.select(render("<LAB> {itemid} {label} ({category}) </LAB>", kinds).alias("text"))


@query("translated_sink", with_views("SELECT subject_id, text_sequence_with_time FROM text_rows", "text_rows"))
def translated_sink(f):
    path = stage_path(f, "translated")
    sinks.write_translated(f.view("text_rows"), path)
    return readers.read_timelines(f.spark, path).select("subject_id", "text_sequence_with_time")


@query("write_mode", with_views("SELECT count(*) AS rows FROM text_rows", "text_rows"))
def write_mode(f):
    path = stage_path(f, "modes")
    rows = f.view("text_rows").select("subject_id")
    rows.write.mode(sinks.write_mode()).parquet(path)
    rows.unionByName(rows).write.mode(sinks.write_mode(skip_existing=True)).parquet(path)  # skipped: it exists
    rows.write.mode(sinks.write_mode(overwrite=True)).parquet(path)
    return f.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
