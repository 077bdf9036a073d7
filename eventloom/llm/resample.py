"""Importance resampling of documents towards a target collection, over hashed n-gram features.

1. Words of a slice come from Arrow kernels (``ascii_lower``, ``split_pattern_regex``,
   ``list_flatten``, ``dictionary_encode``); n-grams are pairs of a shorter n-gram's number and
   the dictionary index shifted to it. Only distinct pairs are hashed, the CRC going on from
   that of the shorter n-gram.
2. Every task adds its features up in one vector of ``buckets`` counts, whatever it reads;
   the vectors of corpus and target are summed by bucket. Nothing here grows with the corpus.
3. A bucket's gain is the log ratio of its shares in target and corpus. A document's weight is
   the mean gain of its features: ``take`` by distinct feature, sums by segment.
4. Weight plus Gumbel noise from the document's id is its score; the documents with the highest
   scores are a sample without replacement. Ranks are places in a range-partitioned order, the
   counts of the partitions before added, so no task sees all scores.

Results by case: null and empty texts have no features and weight 0; a null ``doc_id`` reads as
empty text in the noise and comes first among equal scores; equal scores of equal ids go by the
text's hash, and rows equal in all are ranked each; an empty table gives no rows, and an empty
target equal gains by rarity; one very long text is a slice of its own; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.checksums import CRC_ENTRY, crc32_sql
from eventloom.llm.common import filled, segment_sums, slices, write_once

#: Separators of words once A-Z are lower-case: the other ASCII characters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Longest run of words that is a feature.
LONGEST = 1
#: Documents below so many words are never drawn.
LEAST_WORDS = 20
#: Share of the eligible documents that is drawn, in hundredths.
PERCENT = 10
SEED = "2024"
#: DuckDB: the words of a text.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all texts end to end, and the n + 1 bounds of the texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    encoded = pc.list_flatten(lists).dictionary_encode()
    numbers = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    # Separators at either end of a text leave an empty word.
    empty = pc.index(encoded.dictionary, "").as_py()
    if empty >= 0:
        real = numbers != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        numbers = numbers[real]
    return encoded.dictionary, numbers, bounds


def features(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each n from 1: (bucket of each distinct n-gram, number of the n-gram at each place, bounds of the texts); and words per text."""
    dictionary, words, bounds = _words(texts)
    plain = [word.encode() for word in dictionary.to_pylist()]
    crcs = np.fromiter(map(zlib.crc32, plain), np.int64, len(plain))
    grams, edges, found = words, bounds, [(crcs % buckets, words, bounds)]
    for n in range(2, longest + 1):
        # An n-gram begins wherever one word less fits and another word follows in the same text.
        room = np.diff(edges)
        goes_on = np.ones(len(grams), bool)
        goes_on[edges[1:][room > 0] - 1] = False
        texts_of = np.repeat(np.arange(len(room)), room)
        starts = np.arange(len(grams)) - np.repeat(edges[:-1], room) + np.repeat(bounds[:-1], room)
        pairs = grams[goes_on] * max(1, len(plain)) + words[starts[goes_on] + n - 1]
        distinct, grams = np.unique(pairs, return_inverse=True)
        shorter, last = np.divmod(distinct, max(1, len(plain)))
        crcs = np.fromiter((zlib.crc32(b" " + plain[w], int(crcs[g])) for g, w in zip(shorter, last)), np.int64, len(distinct))
        edges = np.concatenate([[0], np.cumsum(np.bincount(texts_of[goes_on], minlength=len(room)))])
        found.append((crcs % buckets, grams, edges))
    return found, np.diff(bounds)


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for bucket, grams, _ in features(batch.column("text"), longest, buckets)[0]:
                total += np.bincount(bucket[grams], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select(filled(text).alias("text")).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        counts[row["bucket"]] = row["n"]
    return counts


@dataclass(frozen=True)
class Gains:
    """What one feature of each bucket adds to a weight."""

    values: np.ndarray
    longest: int = LONGEST


def fit(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> Gains:
    corpus, wanted = (bucket_counts(df, longest, buckets) for df in (docs, target))
    of_corpus, of_wanted = float(corpus.sum() + buckets), float(wanted.sum() + buckets)
    ratios = [float(t + 1) * of_corpus / (float(s + 1) * of_wanted) for s, t in zip(corpus.tolist(), wanted.tolist())]
    return Gains(np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64), longest)


def weigh(docs: DataFrame, gains: Gains, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``text_hash`` of every document."""
    values, longest = gains.values, gains.longest

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, n_words = features(batch.column("text"), longest, len(values))
            total = np.zeros(batch.num_rows, np.int64)
            n = np.zeros(batch.num_rows, np.int64)
            for bucket, grams, edges in found:
                gain_of = pa.array(values[bucket])
                at_each_place = gain_of.take(pa.array(grams)).to_numpy(zero_copy_only=False)
                total += segment_sums(at_each_place, edges).astype(np.int64)
                n += np.diff(edges)
            columns = [batch.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1)), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(text).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long, text_hash long")


def noise(seed: str = SEED):
    """Gumbel noise of a document, in thousandths, from its id alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place in its partition, from 1."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(seen + 1, seen + 1 + batch.num_rows)
        seen += batch.num_rows
        columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Scores of all documents, and ranks of those drawn."""
    scored = weighed.withColumns({"score": F.col("weight") + noise(seed), "eligible": F.col("n_words") >= least_words})
    # Written first: finding range bounds would otherwise weigh every text twice.
    scored = write_once(scored, "scores").withColumn("copy", F.monotonically_increasing_id())
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc(), F.col("copy").asc()]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    schema = ", ".join(f"{name} {kind}" for name, kind in ranged.dtypes) + ", part int, place long"
    ranged = write_once(ranged.mapInArrow(_numbered, schema), "ranked")
    # One row per partition: small at any size of the corpus.
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("n_eligible")).collect()
    drawn = sum(row["n_eligible"] for row in sizes) * percent // 100
    before, starts = 0, []
    for row in sorted(sizes):
        starts.append((row["part"], before))
        before += row["n"]
    offsets = weighed.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.col("before") + F.col("place")
    ranked = ranged.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every document's features, weight, score and rank in the sample (null: not drawn)."""
    return draw(weigh(docs, fit(docs, target)))


def oracle(least_words: int = LEAST_WORDS, percent: int = PERCENT, buckets: int = BUCKETS, seed: str = SEED) -> str:
    """DuckDB SQL of ``resample`` for single words."""
    return f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda x: {CRC_ENTRY}) AS crcs),
texts AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS words FROM documents),
wanted AS (SELECT {SQL_WORDS} AS words FROM benchmark),
places AS (SELECT r, unnest(words) AS word FROM texts),
wanted_places AS (SELECT unnest(words) AS word FROM wanted),
hashed AS (
  SELECT word, {crc32_sql("word", "crcs")} % {buckets} AS bucket
  FROM (SELECT word FROM places UNION SELECT word FROM wanted_places) w, crc_table),
s AS (SELECT bucket, count(*) AS n FROM places JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted_places JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM places) AS s_all, (SELECT count(*) FROM wanted_places) AS t_all),
gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(s_all + {buckets} AS DOUBLE)
    / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(t_all + {buckets} AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
summed AS (SELECT r, count(*) AS n, sum(gain) AS gain FROM places JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT texts.r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce((gain - ((gain % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST(concat('0x', substr(sha256(concat('{seed}:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) AS h
  FROM texts LEFT JOIN summed USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {percent} // 100 AS drawn
  FROM scored WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank, n_features AS n_words
FROM scored LEFT JOIN ranked USING (r)"""
