"""Benchmark decontamination: BM25 retrieval with block-max WAND, then a check of question and answer.

Test items are cut into units of at most ``UNIT_WORDS`` words, which an inverted index
holds with their BM25 impacts as shares of the unit's own score: a passage that holds
all of a unit scores 1 against it. The units of an index shard lie in blocks, and every
term knows its greatest impact per block.

Every passage of every document is a query: windows of two units' length that overlap
by half, so that a leaked unit lies whole in one of them. As in WAND, only blocks whose
summed maxima reach the threshold are opened, and only their units are scored; a slice's
passages go through the bounds together. Terms found in most blocks are not followed
through their lists for the bound: their greatest impact anywhere is added instead.

A retrieved item counts as leaked if enough words of its question and of its answer
stand in order around the passage. The answer is the item's last sentence, or its last
third if it has one sentence only. One rule holds for all lengths: of all words a share of
``1 - OVERLAP`` may be missing, of the question and of the answer that share or
``SPARE_WORDS`` words, whichever is more. The shorter an item, the fewer words that is; an
item that may miss none must stand there word after word.

The index is cut into shards of bounded size, searched one after the other: documents are
scanned once per shard and never shuffled, and the driver and the executors hold one shard.

Results by case: null and empty texts, and items without a word, match nothing; an empty
table on either side gives no rows; repeated document or item rows give one row per pair of
ids with their greatest scores, and items that share an id (null too) are each looked for;
very long texts are windows like any other; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import filled, slices, write_once

UNIT_WORDS = 32
BLOCK_UNITS = 16
#: Blocks of an index shard at most; bounds the shard and the table of bounds of a slice.
SHARD_BLOCKS = 256
#: Share of a unit's own BM25 score that retrieves it.
THRESHOLD = 0.6
#: Share of the words of question and answer that must stand in order.
OVERLAP = 0.8
#: Words that a question or answer may miss however short it is.
SPARE_WORDS = 2
#: Share of an item's three-word phrases that must stand there too: common words alone can stand in any order.
PHRASES = 0.5
K1, B = 1.2, 0.75
_SEPARATORS = r"[^\p{L}\p{N}]+"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and the n + 1 bounds between texts."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), _SEPARATORS)
    words = lists.flatten().dictionary_encode()
    at = words.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index_in(pa.array([""]), words.dictionary)[0].as_py()
    if empty is not None:
        real = at != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        at = at[real]
    return words.dictionary, at, offsets


def _words(text: str) -> list[str]:
    distinct, at, _ = word_lists(pa.array([text]))
    names = distinct.to_pylist()
    return [names[i] for i in at]


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer."""
    sentences = [w for w in (_words(s) for s in _SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def units(items: DataFrame) -> DataFrame:
    """Rows of the index: ``item_id``, ``unit``, ``question``, ``answer``, distinct ``words`` and their ``shares``.

    Document frequencies and the mean length come from all units of all items.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                question, answer = split_item(text)
                words = question + answer
                if not words:
                    continue
                n = -(-len(words) // UNIT_WORDS)
                for unit in range(n):
                    part = words[len(words) * unit // n : len(words) * (unit + 1) // n]
                    rows.append({"item_id": item_id, "unit": unit, "question": question, "answer": answer, "part": part})
            if rows:
                kind = pa.list_(pa.string())
                schema = pa.schema([("item_id", pa.int64()), ("unit", pa.int32()), ("question", kind), ("answer", kind), ("part", kind)])
                yield pa.RecordBatch.from_pylist(rows, schema)

    source = items.select(F.col("item_id").cast("long").alias("item_id"), filled().alias("text"))
    found = write_once(source.mapInArrow(cut, "item_id long, unit int, question array<string>, answer array<string>, part array<string>"), "units")
    numbered = write_once(found.withColumn("key", F.xxhash64("item_id", "unit", "question", "answer")), "units")
    total = numbered.agg(F.count("*").alias("n"), F.avg(F.size("part")).alias("mean")).first()
    terms = numbered.select("key", F.size("part").alias("size"), F.explode("part").alias("word")).groupBy("key", "size", "word").agg(F.count("*").alias("tf"))
    frequency = terms.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("size") / F.lit(total["mean"] or 1.0))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    weighted = terms.join(frequency, "word").select("key", "word", impact.alias("impact"))
    lists = weighted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("word", "impact"))).alias("terms"))
    whole = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["impact"])
    shares = lists.select("key", F.transform("terms", lambda t: t["word"]).alias("words"), F.transform("terms", lambda t: t["impact"] / whole).alias("shares"))
    return numbered.drop("part").join(shares, "key").drop("key")


class Index:
    """An inverted index of some units, with greatest impacts per block."""

    def __init__(self, rows: list) -> None:
        self.items = [r["item_id"] for r in rows]
        #: Question and answer per unit: ids may be null or shared, so they are labels only.
        self.texts = [(r["question"], r["answer"]) for r in rows]
        self.n_blocks = -(-len(rows) // BLOCK_UNITS)
        names = sorted({w for r in rows for w in r["words"]})
        number = {w: i for i, w in enumerate(names)}
        self.words = pa.array(names, pa.string())
        term = np.array([number[w] for r in rows for w in r["words"]], np.int64)
        unit = np.repeat(np.arange(len(rows)), [len(r["words"]) for r in rows])
        share = np.array([s for r in rows for s in r["shares"]], np.float64)
        order = np.lexsort((unit, term))
        self.units, self.shares = unit[order], share[order]
        self.first = np.searchsorted(term[order], np.arange(len(names) + 1))
        # Block maxima in the same layout: term by term, block by block.
        key = term[order] * self.n_blocks + self.units // BLOCK_UNITS
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block = key[starts] % max(1, self.n_blocks)
        self.block_max = np.maximum.reduceat(self.shares, starts) if len(key) else np.zeros(0)
        self.block_first = np.searchsorted(key[starts] // max(1, self.n_blocks), np.arange(len(names) + 1))
        greatest = np.maximum.reduceat(self.shares, self.first[:-1]) if len(names) else np.zeros(0)
        common = np.diff(self.block_first) * 2 > self.n_blocks
        #: Bound that a common term adds anywhere; 0 for the terms whose lists are followed.
        self.everywhere = np.where(common, greatest, 0.0)
        self.followed = ~common


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its list's positions: (which of ``terms``, position)."""
    length = first[terms + 1] - first[terms]
    ends = np.concatenate([[0], np.cumsum(length)])
    return np.repeat(np.arange(len(terms)), length), np.repeat(first[terms] - ends[:-1], length) + np.arange(ends[-1])


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of two units' length at steps of one: (text, first word, end)."""
    size = np.diff(bounds)
    n = np.where(size > 0, np.maximum(1, -(-size // UNIT_WORDS) - 1), 0)
    text = np.repeat(np.arange(len(size)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[text] + step * UNIT_WORDS
    return text, start, np.minimum(start + 2 * UNIT_WORDS, bounds[text + 1])


def distinct_terms(terms: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, term) of the distinct indexed terms of each passage, in order of passages."""
    at = start[:, None] + np.arange(2 * UNIT_WORDS)
    table = np.where(at < end[:, None], terms[np.minimum(at, len(terms) - 1)], -1)
    table.sort(axis=1)
    new = table >= 0
    new[:, 1:] &= table[:, 1:] != table[:, :-1]
    return np.nonzero(new)[0], table[new]


def retrieve(index: Index, terms: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, unit, score) of all scores of at least ``threshold``, by block bounds first."""
    slack = threshold - 1e-9
    passage, term = distinct_terms(terms, start, end)
    base = np.bincount(passage, index.everywhere[term], len(start))
    rare = index.followed[term]
    which, place = _expand(index.block_first, term[rare])
    key = passage[rare][which] * index.n_blocks + index.block[place]
    bound = np.bincount(key, index.block_max[place], len(start) * index.n_blocks).reshape(len(start), index.n_blocks) + base[:, None]
    open_ = bound >= slack
    wanted = np.flatnonzero(open_.any(axis=1))
    first = np.searchsorted(passage, np.arange(len(start) + 1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(wanted), 256):
        some = wanted[begin : begin + 256]
        owner, at = _expand(first, some)
        which, place = _expand(index.first, term[at])
        row, unit = owner[which], index.units[place]
        inside = open_[some[row], unit // BLOCK_UNITS]
        row, unit, share = row[inside], unit[inside], index.shares[place[inside]]
        n_units = index.n_blocks * BLOCK_UNITS
        score = np.bincount(row * n_units + unit, share, len(some) * n_units)
        hit = np.flatnonzero(score >= slack)
        found.append((some[hit // n_units], hit % n_units, score[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found))


def in_order(wanted: list[str], words: list[str]) -> int:
    """How many of ``wanted`` stand in ``words`` in the same order (longest common subsequence, bit-parallel)."""
    masks: dict[str, int] = {}
    for i, word in enumerate(wanted):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(wanted)) - 1
    state = full
    for word in words:
        both = state & masks.get(word, 0)
        state = ((state + both) | (state - both)) & full
    return len(wanted) - state.bit_count()


def stands(question: list[str], answer: list[str], words: list[str], overlap: float) -> tuple[float, float] | None:
    """Shares of question and answer found, if the item counts as standing in ``words``."""
    spare = (1 - overlap) * (1 + 1e-9)
    item = question + answer
    may_miss = int(spare * len(item))
    if not may_miss:
        n = len(item)
        return (1.0, 1.0) if any(words[i : i + n] == item for i in range(len(words) - n + 1)) else None
    missing = [len(part) - in_order(part, words) for part in (question, answer)]
    if sum(missing) > may_miss or any(m > max(SPARE_WORDS, spare * len(part)) for m, part in zip(missing, (question, answer))):
        return None
    # A missing word breaks up to three phrases; of a long item no more than the share may be broken.
    if missing_phrases(item, words) > min((1 - PHRASES) * (len(item) - 2), 3 * may_miss):
        return None
    return tuple(1.0 - m / len(part) if part else 1.0 for m, part in zip(missing, (question, answer)))


def missing_phrases(wanted: list[str], words: list[str]) -> int:
    """Distinct three-word phrases of ``wanted`` that do not stand in ``words``."""
    phrases = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return len(phrases(wanted) - phrases(words))


def _shards(rows: Iterator, limit: int) -> Iterator[list]:
    """Runs of units of at most ``limit``; units of an item come one after another."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield held
            held = []
    if held:
        yield held


_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Pairs of a document and a test item that it holds; documents without one give no row."""
    spark = docs.sparkSession
    indexed = write_once(units(items), "index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"))
    ordered = indexed.orderBy("item_id", "unit").toLocalIterator()
    found = spark.createDataFrame([], _FOUND)
    for shard in _shards(ordered, shard_blocks * BLOCK_UNITS):
        shared = spark.sparkContext.broadcast(Index(shard))
        # Written at once, so that the next shard can take this one's place.
        found = found.union(write_once(rows.mapInArrow(_search(shared, threshold, overlap), _FOUND), "leaks"))
        shared.unpersist()
    # The units of a long item can lie in two shards.
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def _search(shared, threshold: float, overlap: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            distinct, at, bounds = word_lists(batch.column("text"))
            if not len(at):
                continue
            terms = pc.index_in(distinct, index.words).fill_null(-1).to_numpy(zero_copy_only=False)[at]
            text, start, end = passages(bounds)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for p, unit, score in zip(*retrieve(index, terms, start, end, threshold)):
                item = index.items[unit]
                question, answer = index.texts[unit]
                reach = len(question) + len(answer)
                row = int(text[p])
                low, high = max(int(bounds[row]), int(start[p]) - reach), min(int(bounds[row + 1]), int(end[p]) + reach)
                around = distinct.take(pa.array(at[low:high])).to_pylist()
                found = stands(question, answer, around, overlap)
                if found:
                    best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (float(score), *found))
            if best:
                ids = batch.column("doc_id").take(pa.array([row for row, _ in best]))
                columns = list(zip(*best.values()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([item for _, item in best], pa.int64()), *[pa.array(c, pa.float64()) for c in columns]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return search
