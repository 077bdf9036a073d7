"""Narrative text of token timelines, with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import part, title_text
from eventloom.operators.sequence import term_lookup
from eventloom.operators.word_vocab import spoken
from eventloom.sources.events import subject_labels
from eventloom.sources.tables import ROW_ORDER, read_table

SILENT = ["<start>", "<end>", "<unknown>", "MEDS_BIRTH"]


def narrative_phrases(
    vocab: DataFrame,
    medical: DataFrame | str,
    labs: DataFrame | str,
    pass_age_bins: bool = False,
    pass_bare_gaps: bool = False,
) -> DataFrame:
    """``token``, ``str`` and ``phrase`` for every vocabulary entry.

    ``pass_age_bins`` lets ``AGE: 45-49`` through and ``pass_bare_gaps`` unwrapped
    gap tokens; by default both read ``Unknown``.
    """
    spark = vocab.sparkSession
    terms = None
    for kind, source in (("M", medical), ("L", labs)):
        table = term_lookup(read_table(spark, source)).select(
            F.concat(F.lit(kind), "code").alias("_key"), F.col("term").alias("_term")
        )
        terms = table if terms is None else terms.unionByName(table)
    s = F.col("str")
    raw = F.upper(part(s, 1))
    is_medical = s.startswith("MEDICAL//") | s.startswith("MEASUREMENT//")
    key = F.when(is_medical, F.concat(F.lit("M"), raw)).when(s.startswith("LAB//"), F.concat(F.lit("L"), raw))
    joined = vocab.select("token", "str", key.alias("_key")).join(terms, "_key", "left")
    return joined.select("token", "str", _phrase(s, raw, is_medical, pass_age_bins, pass_bare_gaps).alias("phrase"))


def _phrase(s: Column, raw: Column, is_medical: Column, pass_age_bins: bool, pass_bare_gaps: bool) -> Column:
    term = F.coalesce("_term", title_text(F.replace(raw, F.lit("_"), F.lit(" "))))

    def starts(*prefixes: str) -> Column:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | s.startswith(prefix)
        return test

    interval = F.trim(F.substring_index(s, "_", -1), F.lit(">"))
    phrase = F.when(s.isNull(), F.lit("")).when(starts("<time_interval_"), interval).when(starts("AGE_"), s)
    if pass_age_bins:
        phrase = phrase.when(starts("AGE: "), s)
    if pass_bare_gaps:
        phrase = phrase.when(s.rlike(r"^(TIME )?\d+ (minute|hour|day|week)s?$"), s)
    return (
        phrase.when(is_medical, term)
        .when(starts("LAB//"), F.concat(F.lit("Lab "), term))
        .when(
            starts("BMI//", "HEIGHT//", "WEIGHT//"),
            F.concat(part(s, 0), F.lit(": "), part(s, 1), F.lit(".")),
        )
        .when(starts("GENDER//", "ETHNICITY//"), part(s, 1))
        .when(starts("REGION//"), F.concat(title_text(part(s, 0)), F.lit(": "), part(s, 1)))
        .when(s.rlike(r"^Q\d{1,3}$"), F.substring(s, F.lit(2), F.lit(3)))
        .when(s.isin(SILENT), F.lit(""))
        .otherwise(F.lit("Unknown"))
    )


def narrative_text(timelines: DataFrame, phrases: DataFrame) -> DataFrame:
    """``text`` per timeline: the non-empty phrases of its ids joined by a comma.

    Ids outside the vocabulary are silent. Phrases are computed once per
    vocabulary entry, not per token.
    """
    return _narrated(timelines, phrases).drop("tokens", "timestamps")


def _narrated(timelines: DataFrame, phrases: DataFrame) -> DataFrame:
    said = phrases.where((F.col("phrase") != "") & F.col("phrase").isNotNull())
    return spoken(timelines, said.select("token", F.col("phrase").alias("str")), ", ", strict=False)


def narrative_labels(labels: DataFrame) -> DataFrame:
    """``label`` id (control 0, sites from 1 in alphabetical order) and parsed ``cancer_date``.

    Of several rows per subject the last in source order counts.
    """
    dated = subject_labels(labels)
    named = dated.withColumn("name", F.when(F.col("is_case") == 0, F.lit("Control")).otherwise(F.col("site")))
    # Site names are few; only their distinct values are ranked.
    sites = named.where((F.col("name") != "Control") & F.col("name").isNotNull()).select("name").distinct()
    numbered = sites.withColumn("label", F.dense_rank().over(Window.orderBy("name")))
    row_order = next((c for c in (ROW_ORDER, "file_order") if c in labels.columns), None)
    kept = named.join(numbered, "name", "left").select(
        "subject_id",
        F.when(F.col("name") == "Control", F.lit(0)).otherwise(F.col("label")).alias("label"),
        F.col("cancerdate").alias("cancer_date"),
        (F.col(row_order) if row_order else F.monotonically_increasing_id()).alias("_n"),
    )
    last = kept.groupBy("subject_id").agg(F.max_by(F.struct("label", "cancer_date"), "_n").alias("row"))
    return last.select("subject_id", "row.*")


def narrative_dataset(timelines: DataFrame, phrases: DataFrame, labels: DataFrame) -> DataFrame:
    """``subject_id, text, label, timestamps, cancer_date`` of labelled subjects."""
    known = narrative_labels(labels).where("label is not null")
    keys = [c for c in timelines.columns if c not in ("tokens", "timestamps")]
    labelled = timelines.join(known, "subject_id")
    iso = F.date_format("cancer_date", "yyyy-MM-dd'T'HH:mm:ss")
    return _narrated(labelled, phrases).select(*keys, "text", "label", "timestamps", iso.alias("cancer_date"))
