"""Conversation repair against all edits tried out, and against a plain walk through the rows."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from eventloom.llm import repair

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """Least (cost, audit) by shortest paths; rows are (initial, fault). Shares nothing with the grammar."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in follows[last]:
            if role != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, role))
        if i == len(rows):
            continue
        initial, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            if initial and initial in follows[last]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial))
            for role in follows[last].replace("s", ""):
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, role))


def expected(table, damaged=True):
    """Rows of (conv, turn, role, text) worked through one by one."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(place.encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults)])
        lines, i, spoken = [], 0, 0
        for edit in audit:
            role = ("user", "assistant")[spoken % 2]
            if edit == "I":
                lines.append(role + ":")
            else:
                if edit != "D":
                    lines.append((rows[i][1] if edit == "K" else role) + ":" + rows[i][2])
                    spoken -= edit == "K" and rows[i][1][:1] == "s"
                i += 1
            spoken += edit != "D"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(row) for row in df.select(*COLUMNS).collect()), key=str)


def frame(spark, table):
    rows = [(text, turn, conv, role, "x", 5) for conv, turn, role, text in table]
    return spark.createDataFrame(rows, "text string, turn long, conv_id long, role string, audit string, n int")


def random_table(convs, longest, seed=4, nulls=True):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "s2"] + [None] * nulls
    texts = ["Yes.", "No!", "Why?", "half", " \n", "", "Done. \t", "é日 .x"] + [None] * nulls
    table = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            table.append((conv, rng.choice([turn, turn, turn, turn + 3, None]) if nulls else turn, rng.choice(roles), rng.choice(texts) or rng.choice(texts)))
    return table


@pytest.mark.parametrize("rows", [1, 2, 3, 4])
def test_cells_hold_the_least_of_all_edits(rows):
    """Every sequence of row kinds against every sequence of edits with up to two turns inserted anywhere."""
    kinds = ["s", "u", "a", "x", "ut", "at", "1"]
    gaps = ["", "I", "II"]
    for codes in itertools.product(kinds, repeat=rows) if rows < 4 else random.Random(1).sample(list(itertools.product(kinds, repeat=4)), 60):
        best = None
        for edits in itertools.product(*[["D"] if c == "1" else ["D", "R", "K"] for c in codes]):
            for between in itertools.product(gaps, repeat=rows + 1):
                audit = between[0] + "".join(e + b for e, b in zip(edits, between[1:]))
                cost, roles, fine = 5 * audit.count("I"), "", True
                for part in itertools.chain(between[0], *[(code_edit, *b) for code_edit, b in zip(zip(codes, edits), between[1:])]):
                    if part == "I":
                        roles += "?"
                        continue
                    code, edit = part
                    cost += {"D": 2, "R": 1, "K": 0}[edit] + (5 if edit != "D" and code.endswith("t") else 0)
                    roles += {"D": "", "R": "?", "K": code[0]}[edit]
                tail = roles[1:] if roles.startswith("s") else roles
                fine = not roles or (tail and len(tail) % 2 == 0 and all(r in ("?", "ua"[i % 2]) for i, r in enumerate(tail)))
                if fine and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        cell = repair.parse(list(codes))
        assert min(cell[x] for x in repair.WHOLE if cell[x]) == best, codes


def test_long_conversations_equal_shortest_paths():
    rng = random.Random(9)
    for length in (7, 8, 9, 16, 17, 40, 401):
        rows = [(rng.choice("ssuuuaaax"), rng.choice(["", "", "", "truncated", "blank"])) for _ in range(length)]
        codes = ["1" if f == "blank" else r + ("t" if f else "") for r, f in rows]
        cell = repair.parse(codes)
        assert min(cell[x] for x in repair.WHOLE if cell[x]) == cheapest(rows)


def test_damage_and_repair_equal_the_definition(spark):
    table = random_table(60, 9) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (None, None, None, None)]
    table += [(900, 1, "user", "x" * 300_000 + "."), (900, 2, "assistant", "y" * 300_000 + ".")]
    assert got(repair.damaged_and_repaired(frame(spark, table))) == expected(table)


@pytest.mark.parametrize("cut", [2, 7])
def test_cut_conversations_equal_whole_ones(spark, cut):
    table = random_table(6, 30, seed=8) + [(77, t, r, f"Turn {t // 3}.") for t in range(120) for r in ("user", "assistant")] + [(None, t, "user", "A.") for t in range(20)]
    assert got(repair.damaged_and_repaired(frame(spark, table), cut_rows=cut)) == expected(table)


def test_repeated_rows_are_one_fact(spark):
    table = [(1, 0, "user", "Same.")] * 500 + [(1, 1, "assistant", "Fine.")] * 3 + [(1, 2, "user", "")] * 50
    df = frame(spark, table)
    assert repair.facts(repair.plain_rows(df)).count() == 3
    audited, fixed = repair.repair(repair.plain_rows(df))
    assert got(repair.digest(df, audited, fixed)) == expected(table, damaged=False)
    assert [(r.position, r.edit, r.role, r.text) for r in fixed.collect()] == [(0, "K", "user", "Same."), (1, "K", "assistant", "Fine.")]


def test_conversations_without_rows_left_and_empty_tables(spark):
    gone = next(conv for conv in range(1000) if zlib.crc32(f"{conv}:5".encode()) % 20 == 0)
    assert got(repair.damaged_and_repaired(frame(spark, [(gone, 5, "user", "Hi.")]))) == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert got(repair.damaged_and_repaired(frame(spark, []))) == []
