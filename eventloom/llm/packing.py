"""Best-fit packing of documents into sequences of a fixed capacity, by linear grouping.

1. Every document is encoded and cut into pieces; pieces are a written table.
2. The counts of the lengths, at most ``capacity`` numbers, describe the whole
   problem. ``plan`` solves it on the driver in work that does not grow with the
   corpus: large lengths are rounded up within ``GROUPS`` groups of about equal
   cardinality, the few rounded sizes are filled into configurations, real lengths
   take the places of the rounded ones, the last place of a sequence going to the
   longest piece that its real room holds, and small pieces go to the fullest
   sequence with room.
3. A plan is a list of intervals: pieces of one length with ranks ``r .. r + n``
   go to sequences ``s .. s + n`` at one offset. Pieces are ranked within their
   length in salted groups, so that a length which a third of the corpus shares
   is no single task, and look their place up by binary search.

Results by case: null and empty texts are a piece of the end id alone; an empty
table gives no rows; repeated rows and rows of null or shared ids are packed each;
pieces of one length take their places in the order of the written table, so equal
ones are interchangeable; a very long text is many pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import filled, slices, write_once
from eventloom.llm.encode import encoder, with_end

CAPACITY = 2048
#: Groups of about equal cardinality among the large lengths, each one size for the configurations.
GROUPS = 192
#: Lengths above this share of the capacity are large.
LARGE = 1 / 8
#: Pieces ranked in one group at most, about.
RANK_ROWS = 200_000
#: Salts per length at least.
SALTS = 64

_PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Tells the pieces of a written table apart, whatever their ids.
ROW = "row"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: place in the document, ids (little-endian unsigned 32-bit) and ``row``. A written table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in slices(batches):
            ids, bounds = with_end(*words.encode(batch.column("text")), end_id)
            ids = ids.astype("<u4")
            n = -(-np.diff(bounds) // capacity)
            first = np.concatenate([[0], np.cumsum(n)])
            number = np.arange(first[-1]) - np.repeat(first[:-1], n)
            start = number * capacity
            begin = np.repeat(bounds[:-1], n) + start
            end = np.minimum(begin + capacity, np.repeat(bounds[1:], n))
            offsets = np.concatenate([begin[:1] * 0, np.cumsum(end - begin)]) * 4
            data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(number.astype(np.int32)), pa.array(start), pa.array(end - begin), data],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(text).alias("text"))
    return write_once(rows.mapInArrow(cut, _PIECES).withColumn(ROW, F.monotonically_increasing_id()), "pieces")


def length_counts(cut: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """How many pieces there are of each length, 0 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    return counts


class _Room:
    """Runs of equal sequences by the room left in each."""

    def __init__(self, capacity: int) -> None:
        self.by_room: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, room: int, count: int, items: list) -> None:
        if count:
            self.by_room[room].append((count, items))
            self.mask |= 1 << room

    def tightest(self, need: int) -> int:
        """The least room of at least ``need``, or -1."""
        found = self.mask >> need
        return need + (found & -found).bit_length() - 1 if found else -1

    def take(self, room: int) -> tuple[int, list]:
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return run


def _groups(counts: np.ndarray, large: int, groups: int) -> list[tuple[int, int]]:
    """Linear grouping: (shortest, longest) length of each group, longest group first; a length is in one group whole."""
    total = int(counts[large:].sum())
    each = max(1, -(-total // groups))
    found: list[tuple[int, int]] = []
    held, longest = 0, 0
    for length in range(len(counts) - 1, large - 1, -1):
        if not counts[length]:
            continue
        longest = longest or length
        held += int(counts[length])
        if held >= each:
            found.append((length, longest))
            held, longest = 0, 0
    if held:
        found.append((large, longest))
    return found


class _Large:
    """Large pieces not placed yet: counts and next rank of every length."""

    def __init__(self, counts: np.ndarray, large: int) -> None:
        self.left = [int(n) if length >= large else 0 for length, n in enumerate(counts)]
        self.rank = [0] * len(counts)
        self.mask = sum(1 << length for length, n in enumerate(self.left) if n)

    def longest(self, at_most: int, at_least: int = 0) -> int:
        """The longest length left in a range, or -1."""
        found = ((self.mask & ((1 << (at_most + 1)) - 1)) >> at_least).bit_length() - 1
        return -1 if found < 0 else found + at_least

    def take(self, length: int, n: int) -> int:
        """Take ``n`` pieces; the rank of the first."""
        first = self.rank[length]
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.mask &= ~(1 << length)
        return first


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Copies of each size that fill a sequence best, the largest size left being one of them."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reached = 1
    steps: list[tuple[int, int, int]] = []  # size, copies, what was reachable before
    for i in range(first, len(sizes)):
        most = min(left[i] - (i == first), room // sizes[i])
        copies = 1
        while most > 0:
            n = min(copies, most)
            steps.append((i, n, reached))
            reached |= (reached << (n * sizes[i])) & ((1 << (room + 1)) - 1)
            most, copies = most - n, copies * 2
        if reached >> room & 1:
            break
    filled_up = reached.bit_length() - 1
    chosen = [0] * len(sizes)
    chosen[first] = 1
    for i, n, before in reversed(steps):
        if not before >> filled_up & 1:
            filled_up -= n * sizes[i]
            chosen[i] += n
    return chosen


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE) -> dict[str, np.ndarray]:
    """Intervals of the packing: length, first rank, count, first sequence, offset; and the number of sequences."""
    large = max(1, int(capacity * large_share) + 1)
    ranges = _groups(counts, large, groups)
    pieces_left = _Large(counts, large)
    rooms = _Room(capacity)

    def substitute(chosen: list[int], times: int) -> None:
        """Fill about ``times`` sequences of a configuration with real lengths, in runs of equal ones."""
        slots = [i for i, n in enumerate(chosen) for _ in range(n)]
        while times > 0:
            lengths: list[int] = []
            room = capacity
            for place, i in enumerate(slots):
                # The last place takes the longest piece that the real room holds, of whatever group.
                low, high = (large, room) if place and place == len(slots) - 1 else (ranges[i][0], min(ranges[i][1], room))
                length = pieces_left.longest(high, low)
                while length >= 0 and pieces_left.left[length] <= lengths.count(length):
                    length = pieces_left.longest(length - 1, low)
                if length < 0:
                    break
                lengths.append(length)
                room -= length
            if not lengths:
                return
            n = min(times, *[pieces_left.left[length] // lengths.count(length) for length in lengths])
            items, offset = [], 0
            for length in lengths:
                items.append((length, pieces_left.take(length, n), offset))
                offset += length
            rooms.put(capacity - offset, n, items)
            times -= n
            if len(lengths) < len(slots):
                return  # a group ran out: another configuration is due

    while pieces_left.mask:
        present = [(low, high) for low, high in ranges if pieces_left.longest(high, low) >= 0]
        ranges = present
        sizes = [pieces_left.longest(high, low) for low, high in present]
        left = [sum(pieces_left.left[low : high + 1]) for low, high in present]
        chosen = _configuration(sizes, left, capacity)
        substitute(chosen, min(left[i] // n for i, n in enumerate(chosen) if n))

    def moved(items: list, by: int) -> list:
        return [(length, rank + by, offset) for length, rank, offset in items]

    for length in range(min(large, len(counts)) - 1, 0, -1):
        rank, need = 0, int(counts[length])
        while need:
            room = rooms.tightest(length)
            if room < 0:
                room, bins, items = capacity, need, []
                q = capacity // length
                bins = max(1, need // q)
            else:
                bins, items = rooms.take(room)
                q = room // length
                if need >= q and bins > need // q:
                    rooms.put(room, bins - need // q, moved(items, need // q))
                    bins = need // q
            if need < q:  # the last few go to one sequence
                if bins > 1:
                    rooms.put(room, bins - 1, moved(items, 1))
                bins, q = 1, need
            offset = capacity - room
            added = [(length, rank + i * bins, offset + i * length) for i in range(q)]
            rooms.put(room - q * length, bins, items + added)
            rank, need = rank + q * bins, need - q * bins

    rows, sequence = [], 0
    for room in range(capacity + 1):
        for count, items in rooms.by_room[room]:
            rows += [(length, rank, count, sequence, offset) for length, rank, offset in items]
            sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "count": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4], "sequences": np.array(sequence)}


_RANK_BITS = 44


def place(cut: DataFrame, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length``, ``row`` and any others); ``row`` goes."""
    spark = cut.sparkSession
    solved = plan(counts, capacity, groups)
    # Bounded by the capacity and the number of groups, whatever the corpus.
    shared = spark.sparkContext.broadcast({k: solved[k] for k in ("sequence", "offset")} | {"key": (solved["length"] << _RANK_BITS) + solved["rank"]})
    salts = int(max(SALTS, -(-int(counts.sum()) // RANK_ROWS)))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(ROW), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy(ROW)
    ranked = salted.join(bases, ["length", "_salt"]).withColumn("_rank", F.row_number().over(within) - 1 + F.col("_base"))
    columns = [c for c in cut.columns if c != ROW]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            key = (batch.column("length").to_numpy() << _RANK_BITS) + batch.column("_rank").to_numpy()
            at = np.searchsorted(table["key"], key, side="right") - 1
            sequence = table["sequence"][at] + key - table["key"][at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(table["offset"][at])], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{name} {kind}" for name, kind in cut.dtypes if name != ROW) + ", sequence_id long, offset long"
    return ranked.select(*columns, F.col("_rank").cast("long")).mapInArrow(look_up, schema)


def with_checksum(cut: DataFrame) -> DataFrame:
    """Pieces without their ids, but with the checksum of them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(i.as_buffer()) for i in batch.column("ids")], pa.int64())
            kept = ["doc_id", "piece", "start", "length", ROW]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], sums], [*kept, "ids_crc32"])

    return cut.mapInArrow(check, f"doc_id long, piece int, start long, length long, {ROW} long, ids_crc32 long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from placed pieces with their ``ids``: gapless, in order of place."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` tokens
    packed = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return packed.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
