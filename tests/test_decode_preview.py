"""Encoding and decoding of texts in batches of bounded size."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import pieces, word_vocab
from eventloom.operators.bpe import TextBpe, spelled_in_bytes, vocab_table
from eventloom.operators.pieces import Merges, text_encoder, words_encoder
from eventloom.operators.word_vocab import spoken, with_strings
from eventloom.session import prepare

BATCH_BYTES = 4 << 20


def sent(df):
    """Bytes of the batches that a function in Python gets."""
    import pyarrow as pa

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    return [r["bytes"] for r in df.mapInArrow(measure, "bytes long").collect()]


def test_batches_are_bounded_by_bytes(spark):
    prepare(spark)
    rows = spark.range(0, 4000, 1, 1).select("id", F.expr("sequence(1, 2000)").alias("tokens"))
    assert sum(sent(rows)) > 4000 * 2000 * 4
    assert max(sent(rows)) < BATCH_BYTES + (1 << 20)


@pytest.fixture
def documents(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)] + ["", None, "7", "\n"]
    rows = [(i, text) for i, text in enumerate(texts)]
    rows += rows[:2]  # keys may come twice
    spark.createDataFrame([*rows, (None, "bad ace")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), [*rows, (None, "bad ace")]


def test_preview_encodes_once_and_gives_all_texts(spark, documents, monkeypatch):
    from catalog import all_queries, vocabularies

    monkeypatch.setattr(word_vocab, "SLICE_IDS", 100)
    models = []
    learn = vocabularies.text_bpe
    monkeypatch.setattr(vocabularies, "text_bpe", lambda f: models.append(learn(f)) or models[-1])
    folder, rows = documents
    df = all_queries()["decode_preview"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    model = models[0].model
    strings = dict(model.vocab_rows())
    encode = text_encoder(model, "<unk>", spelled_in_bytes)
    split = spark.createDataFrame(rows, "i bigint, text string").where("text <> ''").select("i", "text", TextBpe.runs(F.col("text")).alias("words"))
    wanted = []
    for row in split.collect():
        ids = [number for word in row["words"] for number in encode(word)]
        wanted.append((row["i"], "|".join(map(str, ids)), "|".join(strings[i] for i in ids), row["text"]))
    got = [(r["subject_id"], r["ids"], r["pieces"], r["text"]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def random_model(rng):
    """Merges of random pairs; strings may be made in more than one way."""
    ids = {s: i for i, s in enumerate(["<unk>", *"abcdÃ©"])}
    known, merges = [*"abcdÃ"], []
    for _ in range(rng.randint(1, 25)):
        left, right = rng.choice(known), rng.choice(known)
        merges.append((left, right, left + right))
        known.append(left + right)
        ids.setdefault(left + right, len(ids))
    return Merges(ids, merges, 7)


@pytest.mark.parametrize("seed", range(12))
def test_words_together_equal_words_one_by_one(seed):
    rng = random.Random(seed)
    model = random_model(rng)
    words = ["".join(rng.choices("abcdéz", k=rng.randint(0, 14))) for _ in range(300)]
    if seed % 4 == 3:
        words += ["ab", "ab"]
    for spell in (None, spelled_in_bytes):
        one = text_encoder(model, "<unk>", spell)
        for some in (words, words[:1], [], [None, "ab", ""]):
            ids, lengths = words_encoder(model, "<unk>", spell)(some)
            each = [[] if word is None else one(word) for word in some]
            assert lengths.tolist() == [len(found) for found in each]
            assert ids.tolist() == [i for found in each for i in found]


def test_many_merges_are_applied_word_by_word(monkeypatch):
    monkeypatch.setattr(pieces, "TOGETHER", 0)
    model = random_model(random.Random(1))
    ids, lengths = words_encoder(model, "<unk>")(["abcd", None, "ba"])
    one = text_encoder(model, "<unk>")
    assert ids.tolist() == one("abcd") + one("ba") and lengths.tolist() == [len(one("abcd")), 0, len(one("ba"))]


@pytest.mark.parametrize("slice_ids", [1, 5, 1 << 18])
def test_joined_strings_in_slices(spark, monkeypatch, slice_ids):
    monkeypatch.setattr(word_vocab, "SLICE_IDS", slice_ids)
    vocab = spark.createDataFrame([(0, "a"), (1, ""), (3, "ccc"), (4, "é")], "token int, str string")
    lists = [[0, 1, 3], [], None, [2, 0, 9, 4], [2], [1, 1], [-1, 3, 2, 3], [4] * 20]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, tokens array<int>").coalesce(1)
    held = {r["i"]: (r["strings"], r["text"]) for r in with_strings(spoken(rows, vocab, ", ", strict=False), vocab).collect()}
    glued = {r["i"]: r["strings"] for r in with_strings(rows, vocab, "|").collect()}
    strings = {0: "a", 1: "", 3: "ccc", 4: "é"}
    for i, ids in enumerate(lists):
        known = [strings[x] for x in ids or [] if x in strings]
        assert held[i] == ([strings.get(x) for x in ids or []], ", ".join(known))
        assert glued[i] == "|".join(known)


def test_an_unknown_id_fails(spark):
    model = TextBpe(10)
    model.model = Merges({"<unk>": 0, "a": 1}, [], 2)
    rows = spark.createDataFrame([(1, [1, 5])], "subject_id int, tokens array<int>")
    assert vocab_table(spark, model.model).count() == 2
    with pytest.raises(Exception, match="no entry for id 5"):
        model.decode(rows).collect()
