"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function of (spark, docs, sf_dir). It works on all that the stage before
kept; its result is written as Parquet and read again as the next one's documents. All
but the last return the columns of ``documents``.

Results by case: a table without rows passes every stage without rows; null texts count as
empty; rows equal in ``doc_id`` and text are copies, of which one stays; rows without a
``doc_id`` and different texts of one are documents of their own, and each is judged by
itself; columns beyond those of ``documents`` are left behind by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, packing, pii, quality, simhash
from eventloom.llm.common import read_table, ready, write_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
END_ID = 0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies above their language's threshold go. Trusted: labelled as good."""
    ready(spark)
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    rejected = quality.classify(docs, trusted, held_out=True, rows=True).where("not keep").select("_row", "lang")
    # Equal texts of two languages have two limits.
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    keyed = docs.withColumns({"_row": quality.row_hash(), "_lang": lang})
    return keyed.join(rejected.select("_row", lang.alias("_lang")), ["_row", "_lang"], "left_anti").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash (3-word shingles, 3 bits) stays: the one with the least id."""
    ready(spark)
    # Written before the join: the choice is made once, whatever is computed again.
    first = write_once(simhash.first_rows(docs), "first-rows")
    # Rows equal in id and text are one before they are shuffled; the join keeps that partitioning.
    one = docs.select(*COLUMNS, *simhash.row_key()).groupBy(*simhash.ROW).agg(F.min(F.struct(*COLUMNS)).alias("first"))
    return one.join(first, simhash.ROW, "left_semi").select(*[F.col("first")[c].alias(c) for c in COLUMNS])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    ready(spark)
    keyed = docs.withColumn("_row", quality.row_hash())
    rows = keyed.select(F.col("_row").alias("doc_id"), "text")
    held = decontaminate.leaks(rows, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(held, "_row", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    ready(spark)
    clean = pii.redact(pii.detect(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces placed in sequences: ``ids`` are little-endian unsigned 32-bit token ids."""
    ready(spark)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return packing.place(cut, packing.length_counts(cut))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: No SQL expresses the language model, the fingerprints or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
