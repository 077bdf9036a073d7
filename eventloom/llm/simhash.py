"""Near duplicates by SimHash fingerprints and bit-sliced comparison.

Documents become 64-bit fingerprints; equal fingerprints are one class from then
on. Two fingerprints within ``radius`` bits agree on one of ``radius + 1`` pieces of
the 64 bits whatever the bits that differ, so classes are grouped by (piece, value)
and compared within groups only: exact, never a sample. The leading bits of a piece
are the key; how many follows from the number of classes, which keeps groups at a
few hundred members at any size, and groups that stay large are cut into blocks.

Within a block one side is stored vertically, as 64 bit planes of one bit per
member. A fingerprint is compared with 64 members at once: the differing bits of
plane after plane go through carry-save counters, and words all of whose members
have passed the radius are abandoned.

Results by case: null and empty texts have no words and the fingerprint zero, which
is linked like any other; a null id is less than none in a component of other ids and stays
null in one of null ids only; an empty table gives no rows; repeated rows and rows of shared
ids each give their own row; a very long text is a slice of its own; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.blocks import by_block, deal, lowest_labels
from eventloom.llm.common import filled, segment_sums, slices, write_once
from eventloom.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Members a group should have, about; sets how many bits of a piece are the key.
GROUP_ROWS = 512
#: Planes added up between two looks at which words are still open.
PLANES_AT_ONCE = 8
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    """Hashes of the word shingles of a text: ASCII letters lower-cased, words between ASCII white space."""
    found = text.lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    joined = map(b" ".join, zip(*[found[i:] for i in range(words)]))
    return [digest(s, seed) for s in joined]


def bit_majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per segment of ``hashes``: the number whose bits are set in more than half of them; zero for an empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    half = np.diff(bounds)
    for bit in range(64):
        ones = segment_sums(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), bounds)
        out |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``carry`` and ``fp``, the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [shingle_hashes(t.as_buffer().to_pybytes()) for t in batch.column("text")]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(bounds[-1]))
            fps = bit_majority(hashes, bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*batch.schema.names[:-1], "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(carry or []), filled(text).alias("text"))
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes[:-1])
    return rows.mapInArrow(make, f"{kinds}, fp long")


def close_pairs(rows: np.ndarray, columns: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in ``rows``, in ``columns``) of fingerprints at most ``radius`` (1 to 3) bits apart, bit-sliced."""
    words = -(-len(columns) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(columns)] = columns
    bits = (padded[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    vertical = np.ascontiguousarray(bits.astype(np.uint8).T)
    planes = np.ascontiguousarray(np.packbits(vertical, axis=1, bitorder="little")).view("<u8")  # plane, word
    absent = np.packbits(np.arange(words * 64) >= len(columns), bitorder="little").view("<u8")
    step = max(1, (1 << 18) // max(1, words))
    for begin in range(0, len(rows), step):
        mine = rows[begin : begin + step]
        q, w = (x.ravel() for x in np.meshgrid(np.arange(len(mine)), np.arange(words), indexing="ij"))
        ones, twos = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        over = absent[w].astype(np.uint64)
        for first in range(0, 64, PLANES_AT_ONCE):
            for bit in range(first, first + PLANES_AT_ONCE):
                query = (np.uint64(0) - ((mine >> np.uint64(bit)) & np.uint64(1)))[q]
                differ = planes[bit][w] ^ query
                carry = ones & differ
                ones ^= differ
                again = twos & carry
                twos ^= carry
                over |= again if radius == 3 else (twos & ones if radius == 2 else twos) | again
            open_ = over != _FULL
            if not open_.any():
                break
            if not open_.all():
                q, w, ones, twos, over = q[open_], w[open_], ones[open_], twos[open_], over[open_]
        else:
            lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            yield begin + q[at], w[at] * 64 + lane


def _compare(low: pa.Table, high: pa.Table | None) -> pa.RecordBatch:
    """Spanning forest of the links of a block, as edges between fingerprints."""
    a = low.column("fp").to_numpy().view(np.uint64)
    b = a if high is None else high.column("fp").to_numpy().view(np.uint64)
    nodes = a if high is None else np.concatenate([a, b])
    shift = 0 if high is None else len(a)
    labels = np.arange(len(nodes))
    for i, j in close_pairs(a, b):
        labels = lowest_labels(labels, i, j + shift)
    moved = np.flatnonzero(labels != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[labels[moved]].view(np.int64))], ["a", "b"])


def key_pieces(n_classes: int, radius: int = RADIUS) -> tuple[int, list[list[tuple[int, int]]]]:
    """Bits of the keys, and per choice of pieces their (lowest bit, width): as few pieces as keep groups small."""
    wanted = max(1, math.ceil(math.log2(max(2, n_classes / GROUP_ROWS))))
    for k in range(1, 5):
        edges = [64 * i // (radius + k) for i in range(radius + k + 1)]
        pieces = [(low, high - low) for low, high in zip(edges, edges[1:])]
        choices = [list(c) for c in itertools.combinations(pieces, k)]
        most = min(sum(width for _, width in c) for c in choices)
        if most >= wanted:
            break
    return min(wanted, most), choices


def _key(choice: list[tuple[int, int]], bits: int, number: int):
    """The leading ``bits`` of the chosen pieces one after another, under the number of the choice."""
    joined, width = F.lit(0).cast("long"), 0
    for low, size in choice:
        piece = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        joined, width = F.shiftleft(joined, size).bitwiseOR(piece), width + size
    return F.shiftrightunsigned(joined, width - bits) + F.lit(number << 48).cast("long")


def links(classes: DataFrame, n_classes: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of a forest that spans the links between distinct fingerprints ``fp``."""
    bits, choices = key_pieces(n_classes, radius)
    keys = [_key(choice, bits, number) for number, choice in enumerate(choices)]
    members = classes.select("fp", F.explode(F.array(*keys)).alias("key"))
    return by_block(deal(members, "key", "fp"), "key", _compare, "a long, b long")


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """Classes ``fp`` with the ``root`` of their component."""
    roots = components(links(classes, classes.count(), radius))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


#: What tells the rows of a table apart: is the id null, the id, the hash of the text.
ROW = ["no_id", "id", "text_hash"]


def row_key(text: str = "text") -> list[Column]:
    """The columns ``ROW``, none of them ever null."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(filled(text)).alias("text_hash")]


def first_rows(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per group of near duplicates the ``ROW`` key of the row with the least id (null ids last)."""
    prints = write_once(fingerprints(docs, carry=row_key()), "fingerprints")
    classes = write_once(prints.groupBy("fp").agg(F.min(F.struct(*ROW)).alias("first")), "classes")
    least = _rooted(classes, radius).groupBy("root").agg(F.min("first").alias("first"))
    return least.select(*[F.col("first")[c].alias(c) for c in ROW])


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the least document id reachable over links, one row per document."""
    prints = write_once(fingerprints(docs), "fingerprints")
    classes = write_once(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    rooted = _rooted(classes, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = write_once(rooted.join(least, "root").select("fp", "component_id"), "class-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """Fingerprints as 16 hexadecimal digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
