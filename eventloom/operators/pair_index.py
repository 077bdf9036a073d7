"""Learning byte-pair merges with an index from pairs to words and signed changes of their counts.

The words, one character per symbol, stay on the executors, and so does the index: one row per
pair and word that held it, with the word as it was after ``version`` merges. A merge reads the
words that the index lists for its pair, brings them up to date, and writes rows for the pairs it
made; all other words and counts stay as they are.

The driver holds the heaviest ``WINDOW`` pairs, with weight and number of words, exact at all
times: changes are added with their sign. It takes merges in three ways.

- A sweep: as long as the next pairs are in a good share of the words there is no index. One pass over the
  words tries up to ``SWEEP_MERGES`` heaviest pairs one after the other and gives the changes of each step; the
  driver takes the steps as long as each is the heaviest pair after the step before, and drops the others.
- A block: the heaviest pairs that ``BLOCK_WORDS`` words hold together. Those words are fetched and
  merges are taken one by one among them. That is exact as long as the heaviest pair is one of the
  block's or holds a symbol made within it, for then all its words are there.
- A round: where one pair alone is in more words, the words are rewritten on the executors and the
  changes of the counts come back summed by pair. Merges of a round share no symbol.

Rows of the index that no longer hold take part in reads until as many were read as the index
has rows; then words, counts and index are written anew.
"""

from __future__ import annotations

import heapq
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialize

#: Pairs whose counts the driver holds.
WINDOW = 200_000
#: Words fetched for a block of merges.
BLOCK_WORDS = 50_000

#: Merges that a sweep tries, and the share (one in so many) of the words that their pairs must be in.
SWEEP_MERGES = 24
SWEEP_SHARE = 4
#: Merges after which the words of the sweeps are written anew.
SWEEPS_KEPT = 96
#: Products of a sweep's steps until they are taken: the last plane, far above any symbol.
_TRIED = 0x100000

_WORDS = pa.schema([("id", pa.int64()), ("word", pa.string()), ("freq", pa.int64())])
_INDEX = "pair string, id long, word string, freq long, version int"
_CHANGES = pa.schema([
    ("pair", pa.string()), ("id", pa.int64()), ("word", pa.string()), ("freq", pa.int64()), ("version", pa.int32()),
    ("weight", pa.int64()), ("words", pa.int64()), ("posted", pa.bool_()),
])
_TALLY = pa.schema([("step", pa.int32()), ("pair", pa.string()), ("weight", pa.int64()), ("words", pa.int64())])
_CHANGES_SQL = _INDEX + ", weight long, words long, posted boolean"


#: Pairs that a lookup names one by one, so that the scan skips row groups; more are joined.
NAMED_PAIRS = 64


def neighbour_pairs(word: Column) -> Column:
    """All overlapping pairs of symbols of a word."""
    return F.regexp_extract_all(word, F.lit("(?s)(?=(..))"), F.lit(1))


def pairs_of(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


@dataclass
class Steps:
    """The merges so far: pair and product by rank, and the ranks of each pair (a pair can come again)."""

    made: list[tuple[str, str]] = field(default_factory=list)
    ranks: dict[str, list[int]] = field(default_factory=dict)

    def add(self, pair: str, product: str) -> None:
        self.ranks.setdefault(pair, []).append(len(self.made))
        self.made.append((pair, product))

    def advance(self, word: str, version: int) -> str:
        """A word after all merges, given as it was after the first ``version``."""
        while True:
            due = [rank for pair in pairs_of(word) for rank in self.ranks.get(pair, ()) if rank >= version]
            if not due:
                return word
            rank = min(due)
            word, version = word.replace(*self.made[rank]), rank + 1


def changes(old: str, new: str, once_per_word: bool) -> tuple[dict[str, int], dict[str, int]]:
    """By pair: how many times more it counts in the new form of a word, and whether the word came (1) or went (-1)."""
    before, after = pairs_of(old), pairs_of(new)
    had, has = set(before), set(after)
    words = dict.fromkeys(has - had, 1) | dict.fromkeys(had - has, -1)
    if once_per_word:
        return words, words
    more: dict[str, int] = {}
    for pair in after:
        more[pair] = more.get(pair, 0) + 1
    for pair in before:
        more[pair] = more.get(pair, 0) - 1
    return more, words


def differences(old: str, new: str, pair: str, product: str, once_per_word: bool) -> Iterator[tuple[str, int, int]]:
    """What ``changes`` gives, as rows, of a merge whose product ``old`` does not hold."""
    at = old.index(pair)
    before, after = old[:at][-1:], old[at + 2 : at + 3]
    if pair[0] == pair[1] or pair in old[at + 2 :] or before + pair[0] == pair[1] + after:
        more, came = changes(old, new, once_per_word)
        for p in more.keys() | came.keys():
            yield p, more.get(p, 0), came.get(p, 0)
        return
    # One place: its pairs go, unless they are elsewhere in the word, and those with the product come.
    yield pair, -1, -1
    for gone, come in ((before and before + pair[0], before + product), (after and pair[1] + after, product + after)):
        if gone:
            stays = gone in new
            yield come, 1, 1
            yield gone, 0 if stays and once_per_word else -1, 0 if stays else -1


@dataclass(frozen=True)
class Progress:
    """One block or round: merges taken, words read through the index, words changed."""

    kind: str
    merges: int
    read: int
    changed: int


class PairIndex:
    """Words, their pairs' counts, and the index, kept up to date with the merges taken."""

    def __init__(self, words: DataFrame, once_per_word: bool, min_weight: int):
        self.spark = words.sparkSession
        self.once, self.min_weight = once_per_word, max(1, min_weight)
        self.window, self.block_words = WINDOW, BLOCK_WORDS
        self.steps = Steps()
        self.progress: list[Progress] = []
        #: The index; None as long as merges are taken in sweeps.
        self.parts: list[DataFrame] | None = None
        self.tries = SWEEP_MERGES // 3
        numbered = words.where(F.length("word") > 1).withColumn("id", F.monotonically_increasing_id())
        self._rebuild(materialize(numbered.select("id", "word", F.col("freq").cast("long").alias("freq")), "pair-words"))

    # Tables

    def _rebuild(self, words: DataFrame, indexed: bool = False) -> None:
        """Counts and, if asked for, the index from all words as they are now."""
        self.words, self.words_version = words, len(self.steps.made)
        words = words.where(F.length("word") > 1)
        self.n_words = words.count()
        version = F.lit(self.words_version).cast("int").alias("version")
        index = words.select(F.explode(F.array_distinct(neighbour_pairs(F.col("word")))).alias("pair"), "id", "word", "freq", version)
        if indexed:
            index = materialize(index.repartitionByRange("pair").sortWithinPartitions("pair"), "pair-index")
            self.parts, self.rows, self.stale = [index], index.count(), 0
        sums = index.groupBy("pair").agg(F.sum("freq").alias("weight"), F.count(F.lit(1)).alias("words"))
        if not self.once:
            places = words.select(F.explode(neighbour_pairs(F.col("word"))).alias("pair"), "freq").groupBy("pair").agg(F.sum("freq").alias("weight"))
            sums = sums.drop("weight").join(places, "pair")
        top = sums.where(F.col("weight") >= self.min_weight).orderBy(F.desc("weight"), "pair").limit(self.window + 1).collect()
        #: Every pair up to this place of the ranking is in ``weight``; None: every pair.
        self.edge = (-top[-1]["weight"], top[-1]["pair"]) if len(top) > self.window else None
        self.weight = {r["pair"]: r["weight"] for r in top}
        self.held = {r["pair"]: r["words"] for r in top}
        self.unsure = False
        self.heap = [(-w, p) for p, w in self.weight.items()]
        heapq.heapify(self.heap)

    def _renew(self, indexed: bool | None = None) -> None:
        now = self._live(self.words.withColumn("version", F.lit(self.words_version)), None)
        indexed = self.parts is not None if indexed is None else indexed
        self._rebuild(materialize(now.where("id >= 0"), "pair-words"), indexed)

    def _live(self, rows: DataFrame, wanted: list[str] | None) -> DataFrame:
        """Words up to date, those with a wanted pair only; one more row per task, of a negative id, counts what was read."""
        shared = self.spark.sparkContext.broadcast((self.steps, None if wanted is None else frozenset(wanted)))

        def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            steps, some = shared.value
            read = 0
            for batch in batches:
                read += batch.num_rows
                found = []
                for row_id, word, freq, version in zip(*[batch.column(c).to_pylist() for c in ("id", "word", "freq", "version")]):
                    word = steps.advance(word, version)
                    if some is None or not some.isdisjoint(pairs_of(word)):
                        found.append({"id": row_id, "word": word, "freq": freq})
                yield pa.RecordBatch.from_pylist(found, _WORDS)
            yield pa.RecordBatch.from_pylist([{"id": -1 - TaskContext.get().partitionId(), "word": "", "freq": read}], _WORDS)

        return rows.select("id", "word", "freq", "version").mapInArrow(advanced, "id long, word string, freq long")

    def _lookup(self, pairs: list[str]) -> DataFrame:
        listed = self.parts[0]
        for part in self.parts[1:]:
            listed = listed.unionByName(part)
        if len(pairs) <= NAMED_PAIRS:
            return self._live(listed.where(F.col("pair").isin(pairs)), pairs)
        # At most as many as a block has words.
        asked = self.spark.createDataFrame(pa.table({"pair": pa.array(sorted(pairs))}))
        within = listed.where(F.col("pair").between(min(pairs), max(pairs)))
        return self._live(within.join(F.broadcast(asked), "pair", "left_semi"), pairs)

    def _append(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > 24:
            # Small parts become one, the large first part stays.
            together = self.parts[1]
            for part in self.parts[2:]:
                together = together.unionByName(part)
            self.parts = [self.parts[0], materialize(together.repartitionByRange("pair").sortWithinPartitions("pair"), "pair-index")]

    # Counts

    def _add(self, weights: dict[str, int], words: dict[str, int], fresh: set[str]) -> None:
        """Add signed changes. ``fresh``: symbols that no word held before."""
        for pair, change in weights.items():
            if pair not in self.weight:
                if change <= 0:
                    continue  # below the edge, and still is
                if self.edge is not None and not (pair[0] in fresh or pair[1] in fresh):
                    self.unsure = True  # was below the edge and may have passed it
                    continue
            total = self.weight.get(pair, 0) + change
            self.held[pair] = self.held.get(pair, 0) + words.get(pair, 0)
            if total <= 0:
                self.weight.pop(pair, None)
                self.held.pop(pair, None)
                continue
            self.weight[pair] = total
            if change:
                heapq.heappush(self.heap, (-total, pair))
        if len(self.weight) > 2 * self.window:
            ranked = sorted((-w, p) for p, w in self.weight.items())
            self.edge = ranked[self.window] if self.edge is None else min(self.edge, ranked[self.window])
            self.heap = ranked[: self.window]
            self.weight = {p: -w for w, p in self.heap}
            self.held = {p: self.held[p] for p in self.weight}

    def _best(self) -> str | None:
        """The pair of the greatest weight (ties: lower symbols), or None if there is none or it is not sure."""
        while self.heap:
            negative, pair = self.heap[0]
            if self.weight.get(pair) != -negative:
                heapq.heappop(self.heap)
                continue
            if -negative < self.min_weight or (self.edge is not None and (negative, pair) > self.edge):
                return None
            return pair
        return None

    def best(self) -> str | None:
        found = None if self.unsure else self._best()
        if found is None and (self.unsure or self.edge is not None):
            self._renew()
            found = self._best()
        return found

    # Merges

    def _ranked(self) -> Iterator[str]:
        """Pairs by rank; what was taken from the heap is put back at the end."""
        taken = []
        try:
            while (pair := self._best()) is not None:
                entry = heapq.heappop(self.heap)
                if not taken or taken[-1] != entry:
                    taken.append(entry)
                    yield pair
        finally:
            for entry in taken:
                heapq.heappush(self.heap, entry)

    def take(self, choose) -> None:
        """Take the next merges. ``choose(pair)`` gives the product and whether it is a new symbol, or None to end."""
        if self.parts is None:
            ahead = self._ahead()
            if self.n_words > self.block_words and sum(self.held[p] for p in ahead) * SWEEP_SHARE > self.n_words:
                self._take_sweep(ahead[: max(1, self.tries)], choose)
                return
            self._renew(indexed=True)
        block, total = [], 0
        ranking = self._ranked()
        for pair in ranking:
            total += self.held[pair]
            if total > self.block_words:
                break
            block.append(pair)
        ranking.close()
        if block:
            self._take_block(block, choose)
        else:
            self._take_round(choose)
        if self.stale > self.rows:
            self._renew()

    def _ahead(self) -> list[str]:
        """The heaviest pairs, as many as a sweep tries."""
        ranking = self._ranked()
        ahead = list(islice(ranking, SWEEP_MERGES))
        ranking.close()
        return ahead

    def _take_sweep(self, ahead: list[str], choose) -> None:
        first = choose(ahead[0])
        if first is None:
            return
        if not first[1]:
            # The product is a symbol that words hold already: all counts may change.
            self.steps.add(ahead[0], first[0])
            self._renew()
            return
        made, once = self.steps.made[self.words_version :], self.once
        tried = [(pair, chr(_TRIED + i)) for i, pair in enumerate(ahead)]

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
            for batch in batches:
                for word, freq in zip(batch.column("word").to_pylist(), batch.column("freq").to_pylist()):
                    for pair, product in made:
                        word = word.replace(pair, product)
                    for step, (pair, product) in enumerate(tried):
                        if pair in word:
                            old, word = word, word.replace(pair, product)
                            for p, times, n in differences(old, word, pair, product, once):
                                held = sums[step, p]
                                held[0] += times * freq
                                held[1] += n
            steps, pairs = [step for step, _ in sums], [pair for _, pair in sums]
            weights, words = [w for w, _ in sums.values()], [n for _, n in sums.values()]
            yield pa.RecordBatch.from_pydict({"step": steps, "pair": pairs, "weight": weights, "words": words}, _TALLY)

        parts = self.words.select("word", "freq").mapInArrow(tally, "step int, pair string, weight long, words long")
        # As many rows as pairs of symbols beside the tried ones.
        rows = parts.groupBy("step", "pair").agg(F.sum("weight").alias("weight"), F.sum("words").alias("words")).collect()
        by_step: dict[int, list] = defaultdict(list)
        for row in rows:
            by_step[row["step"]].append(row)
        products: dict[int, str] = {}
        taken = 0
        for step, pair in enumerate(ahead):
            chosen = first
            if step:
                if self.unsure or self._best() != pair:
                    break
                chosen = choose(pair, alone=False)
                if chosen is None:
                    break
            products[_TRIED + step] = chosen[0]
            self.steps.add(pair, chosen[0])
            weights = {row["pair"].translate(products): row["weight"] for row in by_step[step]}
            words = {row["pair"].translate(products): row["words"] for row in by_step[step]}
            self._add(weights, words, set(products.values()))
            taken += 1
        self.tries = min(SWEEP_MERGES, 2 * taken + 2)
        self.progress.append(Progress("sweep", taken, self.n_words, 0))
        if len(self.steps.made) - self.words_version > SWEEPS_KEPT:
            self._renew()

    def _take_block(self, block: list[str], choose) -> None:
        rows = self._lookup(block).toArrow().to_pylist()
        read = sum(r["freq"] for r in rows if r["id"] < 0)
        found = {r["id"]: (r["word"], r["freq"]) for r in rows if r["id"] >= 0}
        inside, fresh, at_start = set(block), set(), dict(found)
        where: dict[str, set[int]] = defaultdict(set)
        for row_id, (word, _) in found.items():
            for pair in pairs_of(word):
                if pair in inside:
                    where[pair].add(row_id)
        taken = 0
        while (pair := None if self.unsure else self._best()) is not None:
            if pair not in inside and pair[0] not in fresh and pair[1] not in fresh:
                break
            chosen = choose(pair)
            if chosen is None:
                break
            product, new = chosen
            if new:
                fresh.add(product)
            self.steps.add(pair, product)
            taken += 1
            weights: dict[str, int] = defaultdict(int)
            words: dict[str, int] = defaultdict(int)
            for row_id in where.pop(pair, ()):
                old, freq = found[row_id]
                word = old.replace(pair, product)
                if word == old:
                    continue
                found[row_id] = (word, freq)
                more, came = changes(old, word, self.once)
                for p, n in more.items():
                    weights[p] += n * freq
                for p, n in came.items():
                    words[p] += n
                    if n > 0 and (p in inside or p[0] in fresh or p[1] in fresh):
                        where[p].add(row_id)
            self._add(weights, words, fresh)
        version = len(self.steps.made)
        posted = []
        changed = 0
        for row_id, (word, freq) in found.items():
            old = at_start[row_id][0]
            if word != old:
                changed += 1
                posted += [(pair, row_id, word, freq, version) for pair in set(pairs_of(word)) - set(pairs_of(old))]
        if posted:
            names = ("pair", "id", "word", "freq", "version")
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
            table = pa.table({name: pa.array(values, kind) for name, kind, values in zip(names, kinds, zip(*sorted(posted)))})
            self._append(materialize(self.spark.createDataFrame(table).coalesce(1), "pair-index"))
        self._count(Progress("block", taken, read, changed), len(posted))

    def _take_round(self, choose) -> None:
        """Merges that share no symbol, from the head of the ranking.

        A merge only lowers the weights of pairs that share a symbol with it, and a pair that it makes weighs no
        more than such a pair did; on equal weights the new symbol, the last of all, ranks it behind. So the next
        pair of the ranking is the next choice unless it shares a symbol. A pair of a symbol with itself and a
        product that exists already stand alone.
        """
        version, batch, used = len(self.steps.made), [], set()
        fresh: set[str] = set()
        ranking = self._ranked()
        for pair in ranking:
            if batch and (pair[0] == pair[1] or pair[0] in used or pair[1] in used):
                break
            chosen = choose(pair, alone=not batch)
            if chosen is None:
                break
            product, new = chosen
            batch.append((pair, product))
            used |= set(pair)
            if new:
                fresh.add(product)
            if not new or pair[0] == pair[1]:
                break
        ranking.close()
        if not batch:
            return
        once = self.once
        live = self._lookup([pair for pair, _ in batch]).dropDuplicates(["id"])
        for pair, product in batch:
            self.steps.add(pair, product)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for each in batches:
                out = []
                for row in each.to_pylist():
                    if row["id"] < 0:
                        out.append({"pair": "", "weight": row["freq"], "posted": False})
                        continue
                    old = word = row["word"]
                    for pair, product in batch:
                        word = word.replace(pair, product)
                    more, came = changes(old, word, once)
                    out.append({"pair": "", "words": 1, "posted": False})
                    for pair, times in more.items():
                        n = came.get(pair, 0)
                        if n or times:
                            full = {"id": row["id"], "word": word, "freq": row["freq"], "version": version + len(batch)} if n > 0 else {}
                            out.append({"pair": pair, **full, "weight": times * row["freq"], "words": n, "posted": n > 0})
                yield pa.RecordBatch.from_pylist(out, _CHANGES)

        written = materialize(live.mapInArrow(merged, _CHANGES_SQL), "pair-changes")
        sums = written.groupBy("pair").agg(F.sum("weight").alias("weight"), F.sum("words").alias("words"), F.count_if("posted").alias("rows")).collect()
        about = next((r for r in sums if not r["pair"]), None)
        self._add({r["pair"]: r["weight"] for r in sums if r["pair"]}, {r["pair"]: r["words"] for r in sums}, fresh)
        self._append(written.where("posted").drop("weight", "words", "posted"))
        read, changed = (about["weight"] or 0, about["words"] or 0) if about else (0, 0)
        self._count(Progress("round", len(batch), read, changed), sum(r["rows"] for r in sums))

    def _count(self, done: Progress, posted: int) -> None:
        self.progress.append(done)
        self.rows += posted
        self.stale += max(0, done.read - done.changed)


# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
