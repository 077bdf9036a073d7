"""Near duplicates among embeddings by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors. Every vector is
described by its nearest pivots in order; an inverted list per pivot holds the
vectors that name it. Vectors that share enough pivots are candidates, and
candidates are verified by their cosine in double precision.

Lists are compared in blocks of bounded size (``blocks``): cosines of a block are
one matrix product, pairs above the threshold are kept if they share enough
pivots, and a pair is counted in the list of the least pivot that it shares, hence
once. A block reports counts per vector and a spanning forest, not its pairs. Equal
vectors are one class from the start, so copies are never compared.

The number of pivots grows with the square root of the number of vectors, which
keeps work per vector at that order; it is bounded by ``MAX_PIVOTS``.

Results by case: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths never link; equal vectors all link with each other; an empty table gives
no rows; repeated rows each give their own row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.blocks import by_block, deal, lowest_labels
from eventloom.llm.common import write_once
from eventloom.llm.components import components

THRESHOLD = 0.9
#: Nearest pivots that describe a vector, in order.
PREFIX = 8
#: Pivots two vectors must share.
SHARED = 2
#: Pivots closer than this to an earlier one are left out.
PIVOT_COSINE = 0.8
MIN_PIVOTS, MAX_PIVOTS = 64, 8192


def usable(column: str = "embedding"):
    """Whether a vector has a direction: no null or non-finite component, and not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list array of equal lengths, scaled to length one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # else squares of large components overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def sample_pivots(classes: DataFrame, n: int) -> dict[int, tuple[int, np.ndarray]]:
    """First pivot id and pivots by vector length: the vectors with the least hashes, a bounded sample that partitioning cannot change."""
    wanted = int(np.clip(4 * np.sqrt(n), MIN_PIVOTS, MAX_PIVOTS))
    rows = classes.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(2 * wanted).select("vector").collect()
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    chosen, first = {}, 0
    for length, found in by_length.items():
        apart = _apart(_matrix(pa.array(found, pa.list_(pa.float64()))), wanted)
        chosen[length] = (first, apart)
        first += len(apart)
    return chosen


def _apart(unit: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` rows no two of which are closer than ``PIVOT_COSINE``.

    Otherwise a large group of near copies would hold many pivots, and which of them
    are the nearest would differ from one member to the next.
    """
    kept = np.empty((min(wanted, len(unit)), unit.shape[1]))
    n = 0
    for row in unit:
        if n == len(kept):
            break
        if not n or (kept[:n] @ row).max() < PIVOT_COSINE:
            kept[n] = row
            n += 1
    return kept[:n]


def describe(classes: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], prefix: int = PREFIX) -> DataFrame:
    """Add ``pivots``: ids of the nearest pivots, nearest first.

    A vector whose length has no pivot is described by one list for its length (a negative id), compared whole.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                first, known = shared.value.get(int(d), (0, None))
                if known is None:
                    names = np.full((part.num_rows, 1), -int(d))
                else:
                    cosines = _matrix(part.column("vector")) @ known.T
                    k = min(prefix, known.shape[0])
                    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(cosines, top, axis=1), axis=1, kind="stable")
                    names = first + np.take_along_axis(top, order, axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, names.size + 1, names.shape[1]).astype(np.int32), pa.array(names.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("class"), part.column("vector"), lists], ["class", "vector", "pivots"])

    return classes.select("class", "vector").mapInArrow(nearest, "class long, vector array<double>, pivots array<int>")


def _names(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _comparison(threshold: float, shared: int):
    def compare(low: pa.Table, high: pa.Table | None) -> pa.RecordBatch:
        lists = low.column("pivot")[0].as_py()
        a, names_a = _matrix(low.column("vector")), _names(low.column("pivots"))
        b, names_b = (a, names_a) if high is None else (_matrix(high.column("vector")), _names(high.column("pivots")))
        tables = [low] if high is None else [low, high]
        ids, weight = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("class", "weight"))
        shift = 0 if high is None else len(a)
        need = min(shared, names_a.shape[1])
        labels, counts = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for begin in range(0, len(a), 128):
            i, j = np.nonzero(a[begin : begin + 128] @ b.T >= threshold)
            i = i + begin
            if high is None:
                i, j = i[i < j], j[i < j]
            common = np.zeros(len(i), np.int16)
            least = np.full(len(i), np.iinfo(np.int32).max, np.int32)
            for k in range(names_a.shape[1]):
                mine = names_a[i, k]
                both = (mine[:, None] == names_b[j]).any(axis=1)
                common += both
                least = np.where(both & (mine < least), mine, least)
            ours = (common >= need) & (least == lists)
            i, j = i[ours], j[ours] + shift
            counts += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
            labels = lowest_labels(labels, i, j)
        out = np.flatnonzero(counts > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(counts[out]), pa.array(ids[labels[out]])], ["class", "n", "to"])

    return compare


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """``key``, ``n_links`` (other vectors linked directly), ``component_id`` (least id reachable), ``kept``."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(usable(column), F.transform(F.col(column), lambda x: x.cast("double"))).alias("vector"))
    classes = write_once(rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("class"), F.count("*").alias("weight")), "vector-classes")
    pivots = sample_pivots(classes, classes.count())
    described = describe(classes, pivots, prefix).join(classes.select("class", "weight"), "class")
    lists = described.withColumn("pivot", F.explode("pivots"))
    found = write_once(by_block(deal(lists, "pivot", "class"), "pivot", _comparison(threshold, shared), "class long, n long, to long"), "vector-links")
    roots = components(found.select(F.col("class").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    rooted = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("class").alias("component_id"))
    named = rooted.join(least, "root").join(counts, "class", "left")
    named = write_once(named.select("vector", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "vector-components")
    component = F.coalesce("component_id", "id")
    return rows.join(named, "vector", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """All pairs in DuckDB SQL, for small tables."""
    return f"""
WITH RECURSIVE unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {threshold}
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) m ON m.id = e.vec_id"""
