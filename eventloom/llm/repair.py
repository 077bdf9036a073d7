"""Repair of the turn structure of conversations by weighted CYK parsing of row spans.

1. Rows become facts without their texts: place, role, digest of the text, and the first fault
   of each. Equal rows are one fact with a count, merged before the shuffle.
2. A span of rows has a cell: for every symbol of a repair grammar in Chomsky normal form the
   least (cost, audit) of edits that make the rows' roles spell it. Symbols say how the roles
   that a span leaves begin and end, so any two neighbouring spans join by the binary rules.
   A row's cell holds keeping, re-roling and deleting it, closed under inserted turns.
3. Cells are combined bottom-up by span length. Blocks of ``BLOCK`` rows fill the whole chart.
   Above it one split of each span is enough, because the symbols are closed under cutting:
   wherever a legal sequence is cut, both parts are symbols. Two audits of one span, symbol and
   cost are never one the beginning of the other (they would differ by inserted turns, hence in
   cost), so the least audit of a whole is made of least audits of its parts.
4. Conversations above ``CUT_ROWS`` facts are cut by range partitioning; their pieces' cells are
   joined ``FAN`` at a time in further rounds.
5. Texts are shuffled once, sorted by conversation and place, and meet their audit as a stream.

Results by case: a null id, role or text reads as one space, so all rows without an id are one
conversation; null turns come first; rows of one turn go by role, then by the text's digest; an
empty role is no legal one; an empty table gives no rows; other columns are ignored. An audit is
one string, as long as its conversation has rows. The checksum of a conversation's repaired texts
is a chain by definition: they pass through one task as a sorted stream, never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.checksums import CRC_ENTRY, crc32_sql
from eventloom.llm.common import write_once
from eventloom.ordering import gather, in_order, order_groups

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What an edit costs; an undeleted truncated row costs ``TRUNCATED`` more.
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: Rows whose spans fill the whole chart.
BLOCK = 8
#: Facts of a conversation handled in one piece.
CUT_ROWS = 50_000
#: Pieces joined at once.
FAN = 8
SPACE = " \t\n\x0b\x0c\r"

# Symbols by the first and last of the alternating roles that they leave; S leads with a system turn.
NOTHING, U_A, U_U, A_A, A_U, S, S_U, S_A = range(8)
#: Chomsky normal form: the symbol, and the two that it consists of.
RULES = [
    (U_A, U_U, A_A), (U_A, U_A, U_A),
    (U_U, U_A, U_U), (U_U, U_U, A_U),
    (A_A, A_U, A_A), (A_A, A_A, U_A),
    (A_U, A_A, U_U), (A_U, A_U, A_U),
    (S_U, S, U_U), (S_U, S_A, U_U), (S_U, S_U, A_U),
    (S_A, S, U_A), (S_A, S_U, A_A), (S_A, S_A, U_A),
    (NOTHING, NOTHING, NOTHING),
    *[(x, NOTHING, x) for x in range(1, 8)],
    *[(x, x, NOTHING) for x in range(1, 8)],
]
#: What a whole conversation may be.
WHOLE = (NOTHING, U_A, S_A)

Cell = tuple  # per symbol (cost, audit) or None
_KEPT = {"s": S, "u": U_U, "a": A_A}
_INSERTED = tuple((COST[INSERT], INSERT) if x in (U_U, A_A) else None for x in range(8))


def _better(cell: list, symbol: int, cost: int, audit: str) -> bool:
    if cell[symbol] is None or (cost, audit) < cell[symbol]:
        cell[symbol] = (cost, audit)
        return True
    return False


def _meet(cell: list, left: Cell, right: Cell) -> bool:
    """Add what the binary rules make of two neighbouring cells."""
    changed = False
    for symbol, first, second in RULES:
        a, b = left[first], right[second]
        if a is not None and b is not None:
            cost, old = a[0] + b[0], cell[symbol]
            if old is None or cost <= old[0]:
                changed |= _better(cell, symbol, cost, a[1] + b[1])
    return changed


def join(left: Cell, right: Cell) -> Cell:
    cell: list = [None] * 8
    _meet(cell, left, right)
    return tuple(cell)


def close(cell: list) -> Cell:
    """Inserted turns at either end, as long as any symbol gets better."""
    while _meet(cell, _INSERTED, tuple(cell)) | _meet(cell, tuple(cell), _INSERTED):
        pass
    return tuple(cell)


@lru_cache(maxsize=50_000)
def leaf(code: str) -> Cell:
    """Cell of one row (s, u, a or x for other roles; ``t`` follows if truncated) or of a run of rows that must go (their count)."""
    cell: list = [None] * 8
    if code.isdigit():
        _better(cell, NOTHING, COST[DELETE] * int(code), DELETE * int(code))
        return close(cell)
    more = TRUNCATED if code.endswith("t") else 0
    if code[0] in _KEPT:
        _better(cell, _KEPT[code[0]], COST[KEEP] + more, KEEP)
    for symbol in (U_U, A_A):
        _better(cell, symbol, COST[REROLE] + more, REROLE)
    _better(cell, NOTHING, COST[DELETE], DELETE)
    return close(cell)


@lru_cache(maxsize=20_000)
def chart(codes: tuple[str, ...]) -> Cell:
    """Cell of a block: all spans by length, each from all its splits."""
    n = len(codes)
    spans = {(i, i + 1): leaf(code) for i, code in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: list = [None] * 8
            for k in range(i + 1, i + length):
                _meet(cell, spans[i, k], spans[k, i + length])
            spans[i, i + length] = tuple(cell)
    return spans[0, n]


def parse(codes: list[str]) -> Cell:
    """Cell of any number of rows."""
    cells = [chart(tuple(codes[i : i + BLOCK])) for i in range(0, len(codes), BLOCK)]
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


@dataclass
class Piece:
    """What consecutive rows of a conversation amount to."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str | None = None
    last_role: str | None = None
    cell: Cell = ()

    @classmethod
    def of(cls, items: list[dict]) -> "Piece":
        """``items``: turn, role initial, fault and count of the facts in order."""
        piece, codes = cls(), []
        for item in items:
            n, fault, initial = item["n"], item["fault"], item["initial"]
            piece.illegal += n - 1 + (piece.last_role is not None and piece.last_role + initial not in ("su", "ua", "au"))
            piece.first_role = initial if piece.first_role is None else piece.first_role
            piece.last_role = initial
            if item["turn"] is not None:
                piece.turns += piece.last_turn != item["turn"]
                piece.first_turn = item["turn"] if piece.first_turn is None else piece.first_turn
                piece.last_turn = item["turn"]
            # Of equal rows all but the first are duplicates, unless blank.
            gone = n if fault in ("blank", "duplicate") else n - 1
            if gone < n:
                codes.append((initial if initial in _KEPT else "x") + ("t" if fault == "truncated" else ""))
                piece.truncated += fault == "truncated"
            if fault == "blank":
                piece.blank += n
            else:
                piece.duplicate += gone
            if gone:
                if codes and codes[-1].isdigit():
                    gone += int(codes.pop())
                codes.append(str(gone))
        piece.cell = parse(codes)
        return piece

    def then(self, other: "Piece") -> "Piece":
        illegal = self.illegal + other.illegal + (self.last_role + other.first_role not in ("su", "ua", "au"))
        shared = self.last_turn is not None and self.last_turn == other.first_turn
        return Piece(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, illegal,
            self.turns + other.turns - shared,
            other.first_turn if self.first_turn is None else self.first_turn,
            self.last_turn if other.last_turn is None else other.last_turn,
            self.first_role, other.last_role, join(self.cell, other.cell),
        )

    def row(self) -> dict:
        cells = [None if c is None else {"cost": c[0], "audit": c[1]} for c in self.cell]
        return {**self.__dict__, "cell": cells}

    @classmethod
    def from_row(cls, row: dict) -> "Piece":
        cell = tuple(None if c is None else (c["cost"], c["audit"]) for c in row["cell"])
        return cls(**{name: cell if name == "cell" else row[name] for name in cls.__dataclass_fields__})


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_PIECE = (
    ", ".join(f"{name} long" for name in [*_COUNTS, "first_turn", "last_turn"])
    + ", first_role string, last_role string, cell array<struct<cost: long, audit: string>>"
)
_ARROW = pa.schema(
    [("conv", pa.string()), ("chunk", pa.int32())]
    + [(name, pa.int64()) for name in [*_COUNTS, "first_turn", "last_turn"]]
    + [(name, pa.string()) for name in ("first_role", "last_role")]
    + [("cell", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))]
)


def plain_rows(conversations: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and ``n`` (copies): nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turn = F.col("turn").cast("long").alias("turn")
    return conversations.select(space("conv_id").alias("conv"), turn, space("role").alias("role"), space("text").alias("text"), F.lit(1).cast("long").alias("n"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by the checksum of conversation and turn: dropped, emptied, cut, repeated and re-roled rows."""
    place = F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_kind", F.crc32(F.encode(place, "UTF-8")) % 20).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.col("n") * 2).otherwise(F.col("n"))
    return rows.withColumns({"text": text, "n": copies, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))}).drop("_kind")


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.unhex(F.md5(F.encode("text", "UTF-8"))))


def facts(rows: DataFrame) -> DataFrame:
    """Distinct rows without texts: place, count, role's initial and first fault. A written table."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    seen = _with_key(rows).select("conv", "turn", "role", "key", "n", (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"))
    merged = seen.groupBy("conv", "turn", "role", "key", "blank", "ended").agg(F.sum("n").alias("n"))
    # The first place of each role and text: an aggregate and a join, so that copies never meet in one window.
    first = merged.groupBy("conv", "role", "key").agg(F.min(F.struct("turn")).alias("_first"))
    placed = merged.join(first, ["conv", "role", "key"])
    fault = F.when(F.col("blank"), "blank").when(~F.col("_first.turn").eqNullSafe(F.col("turn")), "duplicate").when(~F.col("ended"), "truncated")
    return write_once(placed.select("conv", "turn", "role", "key", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "turn-facts")


def pieces(found: DataFrame, cut_rows: int = CUT_ROWS) -> DataFrame:
    """One row per conversation (``_PIECE``) from its facts."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"conv": r["conv"], "chunk": r["chunk"], **Piece.of(r["items"]).row()} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = [Piece.from_row(part) for part in r["parts"]]
                whole = parts[0]
                for part in parts[1:]:
                    whole = whole.then(part)
                rows.append({"conv": r["conv"], "chunk": r["chunk"], **whole.row()})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    schema = f"conv string, chunk int, {_PIECE}"
    ordered = order_groups(found, ["conv"], ["turn", "role", "key"], limit=cut_rows)
    done = gather(ordered, in_order(ordered, "turn", "initial", "fault", "n").alias("items")).mapInArrow(parsed, schema)
    if not ordered.cut:
        return done
    done = write_once(done, "span-cells")
    most = done.agg(F.max("chunk")).first()[0]
    while most > 1:
        names = ["chunk", *[f.name for f in done.schema if f.name not in ("conv", "chunk")]]
        grouped = done.where("chunk > 0").groupBy("conv", F.ceil(F.col("chunk") / FAN).cast("int").alias("_chunk"))
        parts = grouped.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("parts")).withColumnRenamed("_chunk", "chunk")
        done = write_once(done.where("chunk = 0").unionByName(parts.mapInArrow(joined, schema)), "span-cells")
        most = -(-most // FAN)
    return done


def audits(pieces_of: DataFrame) -> DataFrame:
    """Counts, ``cost`` and ``audit`` of every conversation."""
    whole = F.array(*[F.col("cell")[symbol] for symbol in WHOLE])
    best = F.array_min(F.filter(whole, lambda c: c.isNotNull()))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return pieces_of.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


_REPAIRED = "conv string, position long, edit string, role string, text string"


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows that the audits leave and insert, in order within their partition, with the edit made."""

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, position, alternate = None, "", 0, 0, 0

        def inserts() -> Iterator[dict]:
            nonlocal at, position, alternate
            while at < len(audit) and audit[at] == INSERT:
                yield {"conv": conv, "position": position, "edit": INSERT, "role": ("user", "assistant")[alternate % 2], "text": ""}
                at, position, alternate = at + 1, position + 1, alternate + 1

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    out += inserts()
                    conv, audit, at, position, alternate = row["conv"], row["audit"], 0, 0, 0
                    continue
                for _ in range(row["n"]):
                    out += inserts()
                    edit, role = audit[at], row["role"]
                    at += 1
                    if edit == DELETE:
                        continue
                    if edit == REROLE:
                        role = ("user", "assistant")[alternate % 2]
                    out.append({"conv": conv, "position": position, "edit": edit, "role": role, "text": row["text"]})
                    position += 1
                    alternate += not (edit == KEEP and role.startswith("s"))
            yield pa.RecordBatch.from_pylist(out, _REPAIRED_ARROW)
        yield pa.RecordBatch.from_pylist(list(inserts()), _REPAIRED_ARROW)

    none = lambda kind: F.lit(None).cast(kind)
    texts = _with_key(rows).select("conv", none("string").alias("audit"), "turn", "role", "key", "text", "n")
    heads = audited.select("conv", "audit", none("long").alias("turn"), none("string").alias("role"), none("binary").alias("key"), none("string").alias("text"), none("long").alias("n"))
    both = heads.unionByName(texts).repartition("conv")
    both = both.sortWithinPartitions("conv", F.col("audit").asc_nulls_last(), "turn", "role", "key")
    return both.drop("turn", "key").mapInArrow(edited, _REPAIRED)


_REPAIRED_ARROW = pa.schema([("conv", pa.string()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if state is not None:
                    done.append({"conv": conv, "repaired_sha256": state.hexdigest()})
                conv, state = row["conv"], hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{row['role']}:{row['text']}".encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": state.hexdigest()}], schema)


def digest(conversations: DataFrame, audited: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row per original conversation; ``fixed`` as ``repaired`` gives it."""
    sums = fixed.mapInArrow(_hashed, "conv string, repaired_sha256 string")
    every = plain_rows(conversations).select("conv").distinct()
    joined = every.join(audited, "conv", "left").join(sums, "conv", "left")
    zero = {name: F.coalesce(F.col(name), F.lit(0)).cast("long") for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    filled = joined.withColumns({**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", nothing)})
    conv_id = F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id")
    return filled.select(conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, cut_rows: int = CUT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Audits, and repaired rows, of rows as ``plain_rows`` gives them."""
    audited = write_once(audits(pieces(facts(rows), cut_rows)), "audits")
    return audited, repaired(rows, audited)


def damaged_and_repaired(conversations: DataFrame, cut_rows: int = CUT_ROWS) -> DataFrame:
    audited, fixed = repair(damage(plain_rows(conversations)), cut_rows)
    return digest(conversations, audited, fixed)


def oracle() -> str:
    """DuckDB SQL of ``damaged_and_repaired``: row after row through the states nothing, system, user and assistant said last."""
    space = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    moves = """
      SELECT 0 AS st, 'u' AS heard, 2 AS nxt UNION ALL SELECT 1, 'u', 2 UNION ALL SELECT 2, 'a', 3 UNION ALL SELECT 3, 'u', 2"""
    inserted = """
      SELECT conv, i, st, cost, audit FROM {0} UNION ALL
      SELECT conv, i, nxt, cost + 5, audit || 'I' FROM {0} JOIN moves USING (st) UNION ALL
      SELECT conv, i, CASE nxt WHEN 2 THEN 3 ELSE 2 END, cost + 10, audit || 'II' FROM {0} JOIN moves USING (st)"""
    return f"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda x: {CRC_ENTRY}) AS crcs),
original AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
kinds AS (SELECT *, {crc32_sql("concat(conv, ':', coalesce(CAST(turn AS VARCHAR), ' '))", "crcs")} % 20 AS kind FROM original, crc_table),
damaged AS (
  SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, rtrim(text, {space}) AS body, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before
  FROM placed),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv),
moves AS ({moves}),
hears AS (SELECT st, heard, nxt FROM moves UNION ALL SELECT 0, 's', 1),
steps AS (
  SELECT conv, 0 AS i, 0 AS st, 0 AS cost, '' AS audit FROM counted
  UNION ALL
  SELECT conv, i, st, best.c, best.a FROM (
    SELECT conv, i, st, min(struct_pack(c := cost, a := audit)) AS best FROM (
      WITH ready AS ({inserted.format("steps")}),
      next_row AS (SELECT ready.*, initial, fault, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more
        FROM ready JOIN faults f ON f.conv = ready.conv AND f.i = ready.i + 1)
      SELECT conv, i + 1 AS i, st, cost + 2 AS cost, audit || 'D' AS audit FROM next_row
      UNION ALL
      SELECT conv, i + 1, nxt, cost + 1 + more, audit || 'R' FROM next_row JOIN moves USING (st) WHERE fault NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT conv, i + 1, nxt, cost + more, audit || 'K' FROM next_row JOIN hears USING (st)
      WHERE fault NOT IN ('blank', 'duplicate') AND initial = heard) t
    GROUP BY conv, i, st) u),
ended AS (SELECT steps.* FROM steps JOIN counted USING (conv) WHERE i = n),
chosen AS (
  SELECT conv, min(struct_pack(c := cost, a := audit)) AS best FROM ({inserted.format("ended")}) e WHERE st IN (0, 3) GROUP BY conv),
letters AS (
  SELECT conv, k, substr(best.a, k, 1) AS edit FROM chosen, unnest(range(1, length(best.a) + 1)) AS g(k)),
edits AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv ORDER BY k)),
texts AS (
  SELECT e.conv, k, o, edit, f.role, f.initial, f.text,
    max(CASE WHEN o = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv) AS led
  FROM edits e LEFT JOIN faults f ON f.conv = e.conv AND f.i = e.i WHERE edit <> 'D'),
lines AS (
  SELECT conv, k, concat(CASE WHEN edit = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':',
    CASE edit WHEN 'I' THEN '' ELSE text END) AS line FROM texts),
sums AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM lines GROUP BY conv)
SELECT CAST(nullif(o.conv, ' ') AS BIGINT) AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM original) o LEFT JOIN counted USING (conv) LEFT JOIN chosen USING (conv) LEFT JOIN sums USING (conv)"""
