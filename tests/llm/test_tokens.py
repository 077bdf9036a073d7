"""Token counts, token id files and packing against the libraries themselves and brute force."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventloom.llm import encode, packing, token_counts, tokenids

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "\n\n", "Hello, World! it's we'll IT'S O'Re", "ÀÉÎ é å Å Å", "日本語 テキスト 한국어", "😀😀 x😀y 👩‍👩‍👧",
    "<|endoftext|> tail", "<|ENDOFTEXT|>x", "a<|startoftext|>b.", "tab\tnew space em\x1cfs\x85next", "a.b,c;d:e!f?g", "word.\nword, word? (x).", "İstanbul ǅ ΣΑΣ ß",
    "...", "!!! ???", "à.", "x.̀ y", "1234 5.6 x1y2", "'s 't 're '", "the" * 3000, "é" * 5000, "́ ́a",
]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "abcXYZ éßñ.,;:!?'\n\t -|<>0129😀́ 日"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def library_ids(texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("memo", [5, 100_000])
def test_word_memo_equals_whole_text_encoding(memo):
    import pyarrow as pa

    texts = ODD + random_texts(800)
    encoder = encode.WordEncoder(WORD_BPE, memo_words=memo)
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    for i, want in enumerate(library_ids(texts)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want, repr(texts[i])


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 32])
def test_packed_files_give_every_range_back(bits):
    rng = np.random.default_rng(bits)
    sizes = [0, 5, 1, 300, 0, 77]
    ids = rng.integers(0, 2**bits, sum(sizes), dtype=np.uint64).astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    file = tokenids.IdFile(io.BytesIO(tokenids.encode_file([3, None, 4, -7, 9, 10], bounds, ids, bits, block_ids=32)))
    assert file.doc_ids == [3, None, 4, -7, 9, 10]
    assert (file.read_ids(0, file.n_ids) == ids).all()
    for i in range(len(sizes)):
        assert (file.document(i) == ids[bounds[i] : bounds[i + 1]]).all()
    for a, b in ((31, 33), (0, 1), (64, 64), (100, 383)):
        assert (file.read_ids(a, b) == ids[a:b]).all()


def test_files_round_trip_in_document_order(spark):
    texts = ODD + random_texts(60)
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of a few documents
    try:
        manifest = tokenids.write(df, WORD_BPE, 49408, 2, file_ids=50)
        assert manifest.count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(tuple(r) for r in tokenids.read_back(manifest).collect())
    want, at = [], 0
    by_id = sorted(zip([r[0] for r in rows], library_ids(texts)))
    for doc, ids in by_id:
        full = np.array([*ids, 2], "<u4")
        want.append((doc, at, len(full), zlib.crc32(full.tobytes())))
        at += len(full)
    assert got == sorted(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenids.read_back(tokenids.write(empty, WORD_BPE, 49408, 2)).count() == 0
    cut = packing.pieces(empty, WORD_BPE, 0)
    assert packing.place(cut, packing.length_counts(cut)).count() == 0
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def check_plan(counts, capacity, **options):
    """Every piece has a place, and sequences are gapless; the number of sequences."""
    solved = packing.plan(counts, capacity, **options)
    seen = {}
    for length, rank, n, sequence, offset in zip(*(solved[k] for k in ("length", "rank", "count", "sequence", "offset"))):
        for i in range(n):
            assert (length, rank + i) not in seen
            seen[length, rank + i] = (sequence + i, offset)
    assert sorted(seen) == [(l, r) for l in range(len(counts)) for r in range(counts[l])]
    filled = {}
    for (length, _), (sequence, offset) in seen.items():
        filled.setdefault(sequence, []).append((offset, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == int(solved["sequences"])
    return len(filled)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 64, 128]))
    counts = np.zeros(capacity + 1, np.int64)
    for length in rng.integers(1, capacity + 1, 400):
        counts[int(min(length, rng.integers(1, capacity + 1)))] += 1
    lower = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    for groups, slack in ((3, 1.6), (12, 1.15), (96, 1.02), (packing.GROUPS, 1.02)):
        assert check_plan(counts, capacity, groups=groups) <= lower * slack + 2


def test_plan_of_edge_cases():
    assert check_plan(np.zeros(17, np.int64), 16) == 0
    only = np.zeros(17, np.int64)
    only[16] = 5
    assert check_plan(only, 16) == 5
    only[:] = 0
    only[1] = 33
    assert check_plan(only, 16) == 3
    only[9] = 4
    assert check_plan(only, 16) == 5


def test_packed_documents(spark):
    texts = ODD + random_texts(150) + ["word " * 7000, "same text"] + ["same text"] * 40
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    cut = packing.pieces(df, WORD_BPE, 0)
    placed = packing.place(packing.with_checksum(cut), packing.length_counts(cut))
    rows = placed.collect()
    ids = [[*x, 0] for x in library_ids(texts)]
    by_doc = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert r["start"] == 2048 * r["piece"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    for i, full in enumerate(ids):
        assert sorted(by_doc[i]) == [(k, min(2048, len(full) - 2048 * k)) for k in range(-(-len(full) // 2048))]
    packed = {}
    for r in rows:
        packed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in packed.values():
        assert [o for o, _ in sorted(parts)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(parts)])])[:-1].tolist()
        assert sum(n for _, n in parts) <= 2048
    assert len(packed) == -(-sum(map(len, ids)) // 2048)
    sequences = packing.sequences(packing.place(cut, packing.length_counts(cut))).collect()
    assert sorted(len(s["ids"]) // 4 for s in sequences) == sorted(sum(n for _, n in p) for p in packed.values())


def test_pieces_of_null_and_shared_ids_keep_their_own_ids(spark):
    texts = [f"text number {i} " * (i + 1) for i in range(40)] + ["the same"] * 60
    df = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    cut = packing.pieces(df, WORD_BPE, 0)
    placed = packing.place(cut, packing.length_counts(cut))
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    whole = b"".join(sorted(bytes(r["ids"]) for r in placed.collect()))
    assert whole == b"".join(sorted(np.array([*x, 0], "<u4").tobytes() for x in library_ids(texts)))
    found = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        at = 4 * r["offset"]
        assert found[r["sequence_id"]][at : at + len(r["ids"])] == bytes(r["ids"])


def test_linear_grouping_rounds_to_few_sizes():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    ranges = packing._groups(counts, 257, packing.GROUPS)
    assert len(ranges) <= packing.GROUPS
    assert all(low <= high for low, high in ranges) and all(a[0] > b[1] for a, b in zip(ranges, ranges[1:]))
    lower = -(-int(counts @ np.arange(2049)) // 2048)
    assert check_plan(counts, 2048) <= lower * 1.005


def greedy(word, pieces, longest):
    at = count = 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, count = end, count + 1
    return count


def test_counts_equal_greedy_longest_match(spark):
    pieces = set(token_counts.vocabulary(PIECES))
    longest = max(map(len, pieces))
    texts = ODD + random_texts(300) + ["▁▁a ▁", "x" * 3000 + " " + "the" * 1000, "日" * 2000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(df, PIECES).collect()}
    for i, text in enumerate(texts):
        words = [w for w in __import__("re").split("[ \t\n\x0b\f\r]+", text or "") if w]
        each = [greedy(token_counts.BEGIN + w, pieces, longest) for w in words]
        assert (rows[i]["n_words"], rows[i]["n_tokens"], rows[i]["n_unknown"]) == (len(words), sum(map(abs, each)), each.count(-1)), repr(text)


def test_automaton_on_small_vocabularies():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {"▁"} | {rng.choice(["", "▁"]) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        machine = token_counts.Automaton(sorted(pieces))
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(30)] + ["ab" * 100]
        raw = [w.encode() for w in words]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        got = machine.counts(np.frombuffer(b"".join(raw), np.uint8), bounds).tolist()
        want = [greedy("▁" + w, pieces, 8) for w in words]
        assert got == want
        assert [machine.count_one(w) for w in raw] == want
