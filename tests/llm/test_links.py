"""Near duplicates of texts and vectors against all pairs, with groups cut into many blocks."""

import random

import numpy as np
import pytest
import xxhash

from eventloom.llm import blocks, simhash, vectors
from eventloom.llm.components import components


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    for n, m in ((1, 1), (5, 130), (200, 64), (70, 65)):
        a = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
        b = rng.integers(0, 2**63, m, dtype=np.int64).view(np.uint64)
        for k in range(min(n, m)):
            b[k] = a[k] ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k % 6, replace=False)))
        got = set()
        for i, j in simhash.close_pairs(a, b, radius):
            got |= set(zip(i.tolist(), j.tolist()))
        assert got == {(i, j) for i in range(n) for j in range(m) if int(np.bitwise_count(a[i] ^ b[j])) <= radius}


def copies(rng, base, n):
    words = base.split()
    for _ in range(n):
        changed = list(words)
        for _ in range(rng.randint(0, 2)):
            changed[rng.randrange(len(changed))] = rng.choice(["x", "Y", "z"])
        yield " ".join(changed)


@pytest.mark.parametrize("chunk", [7, 1024])
def test_components_of_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "deal", lambda m, k, c: blocks.deal(m, k, c, chunk))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, " \n", "One", "one", "a b", "A  b", "a b c", "Ä b c", "ä b c"]
    for _ in range(12):
        texts += copies(rng, " ".join(rng.choice(words) for _ in range(120)), rng.randint(1, 14))
    texts += list(copies(rng, " ".join(rng.choice(words) for _ in range(300)), 60)) + ["copy of one text"] * 30
    order = list(range(1, len(texts) + 1))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, t, 0) for i, t in zip(order, texts)], "doc_id long, text string, fp int").repartition(4)
    rows = simhash.digest(simhash.near_duplicates(df)).collect()
    prints = {i: plain_fingerprint(t) for i, t in zip(order, texts)}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in rows)
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {r["doc_id"]: r["component_id"] for r in rows} == roots(prints, pairs)


def test_repeated_rows_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(2, "a"), (2, "a"), (1, "A")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(twice).collect()) == [(1, 1), (2, 1), (2, 1)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (5, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    want = roots({x for e in edges for x in e}, edges)
    same = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert same(found) == same({k: v for k, v in want.items() if k in found})
    assert set(found) == {x for e in edges if e[0] != e[1] for x in e}


def all_links(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    return [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]


@pytest.mark.parametrize("chunk", [16, 1024])
def test_vector_links_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "deal", lambda m, k, c: blocks.deal(m, k, c, chunk))
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(400)]
    center = rng.normal(size=32)
    rows += [(1000 + i, (center + rng.normal(size=32) * 0.15).tolist()) for i in range(120)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)]
    rows += [(3000 + i, (np.array(rows[i][1]) * 3 + rng.normal(size=32) * 0.3).tolist()) for i in range(60)]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 32), (4003, [float("nan")] + [1.0] * 31), (4004, [None] + [1.0] * 31), (4005, [float("inf")] + [1.0] * 31)]
    rows += [(5000, [1.0, 0.0]), (5001, [2.0, 0.0]), (5002, [1.0, 0.1]), (6000, [1e300] * 32), (6001, [1e-300] * 32)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int").repartition(4)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    pairs = [p for p in all_links(rows) if not {6000, 6001} & set(p)] + [(6000, 6001)]
    pairs += [(a, b) for a, b in all_links([(i, [1.0] * 32) if i in (6000, 6001) else (i, v) for i, v in rows]) if (a in (6000, 6001)) != (b in (6000, 6001))]
    degree = {i: 0 for i, _ in rows}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    want = roots(degree, pairs)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * sum(degree.values()) and all(got[i]["n_links"] <= degree[i] for i in degree)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_vectors_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n_classes", [10, 10**6, 10**8, 10**11, 10**15])
def test_some_choice_of_pieces_agrees_within_the_radius(n_classes):
    bits, choices = simhash.key_pieces(n_classes)
    assert bits <= min(sum(width for _, width in c) for c in choices)
    assert n_classes / 2**bits <= simhash.GROUP_ROWS or bits >= 36
    rng = random.Random(n_classes)
    for _ in range(300):
        differ = sum(1 << b for b in rng.sample(range(64), simhash.RADIUS))
        assert any(all((differ >> low) & ((1 << width) - 1) == 0 for low, width in c) for c in choices)


def test_links_are_the_same_with_keys_of_several_pieces(spark, monkeypatch):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(120)]
    for p in list(prints):
        for _ in range(3):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [p - (1 << 64) if p >> 63 else p for p in set(prints)]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")

    def groups():
        found = {}
        for r in components(simhash.links(classes, len(signed))).collect():
            found.setdefault(r["root"], set()).add(r["node"])
        return sorted(map(sorted, found.values()))

    few = groups()
    monkeypatch.setattr(simhash, "GROUP_ROWS", len(signed) / 2**24)
    assert len(simhash.key_pieces(len(signed))[1]) == 10
    assert groups() == few
    monkeypatch.setattr(simhash, "GROUP_ROWS", len(signed) / 2**30)
    assert len(simhash.key_pieces(len(signed))[1]) == 20
    assert groups() == few


def test_first_rows_of_null_and_shared_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "other words here now"), (None, "quite another text"), (9, "A  B c\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {tuple(r)[:2] for r in simhash.first_rows(df).collect()}
    assert first == {(False, 5), (True, 0)} and simhash.first_rows(df).count() == 3
    assert simhash.first_rows(df.where("false")).count() == 0
