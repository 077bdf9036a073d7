"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's units are the bytes of a text, with its n-grams as exact integers
(``order`` bytes, at most 7): the context is the number without its last byte, the
shorter n-gram the number without its first. Counts of all trusted text, continuation
counts, discounts and back-off weights are DataFrame aggregations and joins.

Scoring asks first which n-grams occur in the documents at all (distinct within each
task before the shuffle), then gets the probability of each of those by joining the
counts of every order, and cuts the answers into shards of bounded size. Documents
meet one shard after another and add up what it knows, so no model of unbounded size
is ever broadcast. Texts are shuffled once, to pick the trusted ones by id; scoring shuffles none.

A document is rejected if its log perplexity lies above its language's threshold: a
quantile of the trusted documents of that language, plus a margin for short texts,
whose mean varies more. Thresholds come from a histogram with bins of fixed width over
all trusted documents, so they do not depend on partitioning. With ``held_out`` the trusted
documents are scored without their own counts, as documents outside the labels are, and
the quantile is taken of the score less the margin, so that length is allowed for once.

Results by case: null and empty texts have no bytes, perplexity 1 and are kept; a
language without trusted documents takes the threshold of all, with ``held_out`` one of
fewer than ``MIN_TRUSTED`` has no threshold and is kept whole (no language is one too);
without any trusted document nothing is rejected; an empty table gives no rows; repeated rows each give
their own row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import filled, segment_sums, slices, text_bytes, write_once

#: Bytes of an n-gram.
ORDER = 5
#: Share of a language's trusted documents that lie below its threshold.
QUANTILE = 0.995
#: Added to the threshold for a text of n bytes: MARGIN / sqrt(n).
MARGIN = 8.0
#: Trusted documents a language needs to have a threshold of its own.
MIN_TRUSTED = 20
#: Width of the histogram bins of log perplexity.
BIN = 0.001
#: N-grams of a shard of answers at most.
SHARD_ROWS = 2_000_000


def codes(raw: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as an integer; bytes before a text's first are zero."""
    out = np.zeros(len(raw), np.int64)
    place = np.arange(len(raw)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(min(order, len(raw))):
        shifted = np.zeros(len(raw), np.int64)
        shifted[back:] = raw[: len(raw) - back]
        shifted[place < back] = 0
        out |= shifted << (8 * back)
    return out


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``code`` and ``n`` of all n-grams of the texts, added up within each slice before the shuffle.

    ``low`` and ``high`` are the least and greatest mark of the texts that hold it: equal if it is one text's own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, bounds = text_bytes(batch.column("text"))
            mark = np.repeat(batch.column("mark").to_numpy(), np.diff(bounds))
            found = pa.table({"code": codes(raw, bounds, order), "mark": mark}).group_by("code").aggregate([("code", "count"), ("mark", "min"), ("mark", "max")])
            found = found.select(["code", "code_count", "mark_min", "mark_max"]).rename_columns(["code", "n", "low", "high"])
            yield from found.combine_chunks().to_batches()

    # Copies of a text have its mark. A short tells two texts apart but for one pair in 65,536.
    marked = docs.select("text", F.shiftright(F.xxhash64("text"), 48).cast("short").alias("mark"))
    marks = [F.min("low").alias("low"), F.max("high").alias("high")]
    return marked.mapInArrow(count, "code long, n long, low short, high short").groupBy("code").agg(F.sum("n").alias("n"), *marks)


def needed_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The distinct n-grams of the texts; each task drops its own repeats first."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array([], pa.int64())
        for batch in slices(batches):
            fresh = pc.unique(pa.array(codes(*text_bytes(batch.column("text")), order)))
            held = pc.unique(pa.concat_arrays([held, fresh]))
            if len(held) > SHARD_ROWS:
                yield pa.RecordBatch.from_arrays([held], ["code"])
                held = held[:0]
        yield pa.RecordBatch.from_arrays([held], ["code"])

    return docs.select("text").mapInArrow(distinct, "code long").distinct()


def _shorter(code: Column, length: int) -> Column:
    """An n-gram of ``length`` bytes without its first."""
    return code.bitwiseAND(F.lit((1 << (8 * (length - 1))) - 1))


def _context(code: Column) -> Column:
    """An n-gram without its last byte."""
    return F.shiftright(code, 8)


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of n-grams counted once, twice, and more often, from the counts of counts."""
    row = counts.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    two = 2 - 3 * y * n3 / n2
    three = 3 - 4 * y * n4 / n3 if n3 else two
    # Where counts are few the estimates can leave their range.
    return tuple(float(np.clip(d, 0.05, high)) for d, high in ((1 - 2 * y * n2 / n1, 1.0), (two, 2.0), (three, 3.0)))


def model(trusted: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Per length 1 to ``order``: n-grams (``code``, ``top``: discounted count) and contexts (``ctx``, ``total``, ``back``: discount mass).

    ``gone`` is the count that a text which holds the n-gram is taken to bring itself: all if no other text holds
    it, else one; ``top_q`` is ``top`` without it; ``ctx_own`` says that no other text holds the context.

    The longest n-grams have their counts, shorter ones the number of different bytes that precede them.
    """
    tables = []
    counts = write_once(count_ngrams(trusted, order), "ngrams")
    for length in range(order, 0, -1):
        d1, d2, d3 = _discounts(counts)
        less = lambda n: F.when(n < 1, 0.0).otherwise(n - F.when(n == 1, d1).when(n == 2, d2).otherwise(d3))  # noqa: B023, E731
        gone = F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(1)
        grams = counts.select("code", less(F.col("n")).alias("top"), gone.alias("gone"), less(F.col("n") - gone).alias("top_q"))
        sums = [F.sum("n").alias("total")] + [F.sum(t.cast("long")).alias(f"k{k}") for k, t in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))]
        totals = counts.groupBy(_context(F.col("code")).alias("ctx")).agg(*sums, (F.min("low") == F.max("high")).alias("ctx_own"))
        contexts = totals.select("ctx", "total", "ctx_own", (F.lit(d1) * F.col("k1") + F.lit(d2) * F.col("k2") + F.lit(d3) * F.col("k3")).alias("back"))
        tables.append((grams, write_once(contexts, "contexts")))
        if length > 1:
            shorter = counts.groupBy(_shorter(F.col("code"), length).alias("code")).agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            counts = write_once(shorter, "ngrams")
    return tables[::-1]


def probabilities(needed: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``code`` and ``logp`` of every needed n-gram: joins with the counts of every order, shortest first.

    ``logq`` is the same for a trusted text that holds the n-gram, its own counts left out.
    """
    order = len(tables)
    codes_by_length = [write_once(needed, "needed")]
    for length in range(order, 1, -1):
        shorter = codes_by_length[-1].select(_shorter(F.col("code"), length).alias("code")).distinct()
        codes_by_length.append(write_once(shorter, "needed"))
    p = None
    for length, (grams, contexts) in enumerate(tables, 1):
        asked = codes_by_length[order - length].withColumn("ctx", _context(F.col("code")))
        found = asked.join(grams, "code", "left").join(contexts, "ctx", "left")
        if p is None:
            lower = lower_q = F.lit(1 / 256)
        else:
            found = found.withColumn("below", _shorter(F.col("code"), length)).join(p.select(F.col("code").alias("below"), F.col("p").alias("lower"), F.col("q").alias("lower_q")), "below")
            lower, lower_q = F.col("lower"), F.col("lower_q")
        value = F.when(F.col("total").isNull(), lower).otherwise((F.coalesce("top", F.lit(0.0)) + F.col("back") * lower) / F.col("total"))
        # The discount mass changes by what the n-gram's own discount does.
        without = (F.col("top_q") + (F.col("back") + F.col("top") - F.col("top_q") - F.col("gone")) * lower_q) / (F.col("total") - F.col("gone"))
        unknown = F.col("gone").isNull() | F.col("ctx_own") | (F.col("total") <= F.col("gone"))
        held_out = F.when(unknown, lower_q).otherwise(without)
        p = write_once(found.select("code", value.alias("p"), held_out.alias("q")), "ngram-p")
    return p.select("code", F.log("p").alias("logp"), F.log("q").alias("logq"))


def row_hash() -> Column:
    """What tells rows of one id, or of none, apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), filled())


_SCORED = "_row long, doc_id long, lang string, n_bytes long, total double, held_out double"


def scores(docs: DataFrame, logs: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Log probability of every document: one pass per shard of answers, each adding up the n-grams it knows."""
    spark = docs.sparkSession
    logs = write_once(logs, "ngram-log")
    numbered = docs.select(row_hash().alias("_row"), "doc_id", "lang", "text")
    shards = max(1, -(-logs.count() // shard_rows))
    # Salted hashing spreads n-grams evenly: a shard is within a few rows of its share.
    parts = write_once(logs.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int")), "ngram-shards") if shards > 1 else logs.withColumn("shard", F.lit(0))
    found = None
    for shard in range(shards):
        table = parts.where(F.col("shard") == shard).select("code", "logp", "logq").toArrow()
        known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "logp", "logq")))

        def add(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            keys, logp, logq = known.value
            keys, values = pa.array(keys), [np.append(v, 0.0) for v in (logp, logq)]
            for batch in slices(batches):
                raw, bounds = text_bytes(batch.column("text"))
                at = pc.index_in(pa.array(codes(raw, bounds, order)), keys).fill_null(len(logp)).to_numpy()
                sums = [pa.array(np.array([each[a:b].sum() for a, b in zip(bounds[:-1], bounds[1:])])) for each in (v[at] for v in values)]
                columns = [batch.column(c) for c in ("_row", "doc_id", "lang")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), *sums], ["_row", "doc_id", "lang", "n_bytes", "total", "held_out"])

        one = numbered.mapInArrow(add, _SCORED)
        found = one if found is None else found.union(one)
    if shards > 1:
        # Equal rows meet in one group: as many as it has parts, divided by the shards.
        added = found.groupBy("_row", "doc_id", "lang", "n_bytes").agg(F.sum("total").alias("total"), F.sum("held_out").alias("held_out"), (F.count("*") / shards).cast("int").alias("copies"))
        found = added.withColumns({c: F.col(c) / F.col("copies") for c in ("total", "held_out")}).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select("_row", "doc_id", "lang", "n_bytes", "total", "held_out")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang`` (null: all languages), ``limit``: the bin below which the quantile of its trusted documents lies, and their number ``texts``."""
    trusted = scored.where("trusted and n_bytes > 0").select("lang", F.floor(F.col("log_perplexity") / BIN).alias("bin"))
    bins = trusted.groupBy("lang", "bin").count()
    every = bins.groupBy("bin").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("lang"), "bin", "count")
    both = bins.where("lang is not null").select("lang", "bin", "count").union(every)
    # As many rows as bins, whatever the number of documents.
    running = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    ranked = both.withColumn("below", F.sum("count").over(running)).withColumn("all", F.sum("count").over(whole))
    return ranked.where(F.col("below") >= F.col("all") * quantile).groupBy("lang").agg(((F.min("bin") + 1) * BIN).alias("limit"), F.max("all").alias("texts"))


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, held_out: bool = False, rows: bool = False) -> DataFrame:
    """``doc_id``, ``lang``, ``n_bytes``, ``perplexity``, ``limit``, ``keep``, one row per document.

    ``trusted_ids`` holds the ``doc_id`` of documents known to be good; all of their text trains the model.
    ``held_out`` takes the thresholds from scores that leave each trusted document's own counts out. ``rows`` adds ``_row``, the ``row_hash`` of each row.
    """
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), filled().alias("text"))
    # Labels grow with the documents, so they are never broadcast: one plan at every size.
    tables = model(texts.join(ids.hint("merge"), "doc_id", "left_semi"), order)
    logs = probabilities(needed_ngrams(texts, order), tables)
    scored = scores(texts, logs, order).join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    mean = lambda c: F.when(F.col("n_bytes") > 0, -F.col(c) / F.col("n_bytes")).otherwise(0.0)
    scored = write_once(scored.withColumns({"log_perplexity": mean("total"), "held_out": mean("held_out")}), "scored")
    scored = scored.withColumn("_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    if held_out:
        # Limits grow for short texts again, so the quantile is taken of what is left without that.
        long_text = F.col("held_out") - F.lit(margin) / F.sqrt(F.greatest("n_bytes", F.lit(1)))
        limits = thresholds(scored.select("trusted", "n_bytes", F.col("_lang").alias("lang"), long_text.alias("log_perplexity")), quantile)
        own = limits.where(F.col("lang").isNotNull() & (F.col("texts") >= MIN_TRUSTED)).select(F.col("lang").alias("_lang"), "limit")
        return decide(scored, own, None, margin, rows)
    limits = thresholds(scored, quantile)
    own = limits.where("lang is not null").select(F.concat(F.lit("="), "lang").alias("_lang"), "limit")
    common = limits.where("lang is null").select(F.max("limit").alias("_common"))
    return decide(scored, own, common.first()["_common"], margin, rows)


def decide(scored: DataFrame, own: DataFrame, fallback: float | None, margin: float, rows: bool = False) -> DataFrame:
    """Keep what lies at or below its limit, or has none; few rows of limits are joined by language."""
    limit = F.coalesce("limit", F.lit(fallback).cast("double")) + F.lit(margin) / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    joined = scored.join(F.broadcast(own), "_lang", "left").withColumn("limit", limit)
    keep = (F.col("n_bytes") == 0) | F.coalesce(F.col("log_perplexity") <= F.col("limit"), F.lit(True))
    return joined.select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), "limit", keep.alias("keep"), *["_row"] * rows)
