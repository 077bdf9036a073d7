"""Registered queries of the operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from eventloom.llm import archive, decontaminate, language, licenses, packing, pii, quality, repair, resample, simhash, token_counts, tokenids, vectors
from eventloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLES["op3_vectors"] = vectors.oracle()


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; documents held out train nothing."""
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    held_out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", language.held_out())
    return language.identify(held_out, model, carry=["held_out"])


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.digest(pii.detect(read_table(spark, sf_dir, "documents")))


ORACLES["op6_pii"] = pii.oracle()


@query
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of all documents' ids, read back from their files."""
    manifest = tokenids.write(read_table(spark, sf_dir, "documents"), word_bpe(), vocabulary=49408, end_id=2)
    return tokenids.read_back(manifest)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    cut = packing.pieces(read_table(spark, sf_dir, "documents"), word_bpe(), end_id=0)
    return packing.place(packing.with_checksum(cut), packing.length_counts(cut))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and whether it is kept."""
    labels = read_table(spark, sf_dir, "labels")
    return quality.classify(read_table(spark, sf_dir, "documents"), labels.where("quality = 1"), held_out=True)


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document."""
    return licenses.digest(licenses.detect(read_table(spark, sf_dir, "documents")))


ORACLES["op10_licenses"] = licenses.oracle()


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the test collection, and its rank in the sample."""
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op11_resampling"] = resample.oracle()


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record type, size and digest of every page, read back from the archive."""
    return archive.archived(read_table(spark, sf_dir, "pages"))


ORACLES["op12_warc"] = archive.oracle()


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after planted damage, and the cheapest repair."""
    return repair.damaged_and_repaired(read_table(spark, sf_dir, "conversations"))


ORACLES["op13_repair"] = repair.oracle()
