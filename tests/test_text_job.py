"""Vocabulary sizes from one scan, and the text job's stages."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators.bpe import TextBpe, text_eval
from eventloom.operators.phrases import EventPhrases
from eventloom.operators.pieces import lengths_at, merge_ranks, split_word
from eventloom.plans.text_job import run_text_job
from eventloom.plans.text_vocab import counted_words, vocab_experiments, vocab_folder
from eventloom.sources.sinks import write_shards


def test_lengths_at_every_cut_equal_separate_runs():
    rng = random.Random(2)
    for _ in range(200):
        symbols, merges = list("abc"), []
        for _ in range(8):
            left, right = rng.choice(symbols), rng.choice(symbols)
            merges.append((left, right, left + right))
            symbols.append(left + right)  # products can repeat, so later merges make earlier pairs
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        cuts = list(range(len(merge_ranks(merges)) + 1))
        pairs = list(merge_ranks(merges))
        want = [len(split_word(word, {p: i for i, p in enumerate(pairs[:cut])}, list(word))) for cut in cuts]
        assert lengths_at(word, merge_ranks(merges), cuts) == want


def texts_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "subject_id bigint, text string")


def test_sizes_in_one_scan_equal_encoding_at_each(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice(["aaab", "abab", "bcbc 12", "cab.", "é日"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    train, test = texts_of(spark, lines[:40]), texts_of(spark, lines[40:])
    sizes = [20, 24, 31, 31, 400]
    rows = {tuple(r) for r in vocab_experiments(train, test, "text", sizes, 2).collect()}
    tokenizer = TextBpe(400, 2).train_texts(F.col("text"), train)
    for size in sizes:
        n = sum(len(r.tokens) for r in tokenizer.cut(size).encode_texts(test, "text").collect())
        assert (size, round(n / 20, 2), round(sum(map(len, lines[40:])) / n, 2), n) in rows
    scans = counted_words(tokenizer, test, "text")
    plan = text_eval(scans, tokenizer.model, sizes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD[subject_id") == 1
    none = vocab_experiments(train, test.where("false"), "text", [20], 2).collect()
    assert [tuple(r) for r in none] == [(20, 0.0, 0.0, 0)]


def test_stages_run_skip_and_overwrite(spark, fixtures, tmp_path):
    shards, texts, vocabularies, encoded = (f"{tmp_path}/{name}" for name in ("events", "texts", "vocabularies", "encoded"))
    write_shards(fixtures.events(), shards)
    phrases = EventPhrases(fixtures.labitems(), fixtures.icd(), fixtures.icd())
    translation = {"meds_root": shards, "output_root": texts, "splits": ["train", "tuning", "absent"]}
    training = {"data_root": texts, "output_dir": vocabularies, "vocab_sizes": [80, 90]}
    encoding = {"data_root": texts, "tokenizer_dir": vocab_folder(vocabularies, 90), "output_root": encoded, "splits": ["train", "tuning"]}
    first = run_text_job(spark, {"translation": translation, "bpe_training": training, "encoding": {**encoding, "enabled": False}}, phrases)
    assert first == {"translation": ["train", "tuning"], "bpe_training": [80, 90]}
    again = run_text_job(spark, {"translation": translation, "bpe_training": {**training, "enabled": False}, "encoding": encoding}, phrases)
    assert again == {"translation": [], "encoding": ["train", "tuning"]}
    assert run_text_job(spark, {"translation": {**translation, "overwrite": True}}, phrases) == {"translation": ["train", "tuning"]}
    assert run_text_job(spark, {}) == {}
    learned = TextBpe(90, 2).train_texts(F.col("text_sequence_with_time"), spark.read.parquet(f"{texts}/train"))
    loaded = TextBpe.load(spark, vocab_folder(vocabularies, 90))
    assert loaded.model == learned.model
    want = {r.subject_id: r.tokens for r in learned.encode_texts(spark.read.parquet(f"{texts}/tuning"), "text_sequence_with_time").collect()}
    assert {r.subject_id: r.tokens for r in spark.read.parquet(f"{encoded}/tuning").collect()} == want
    with pytest.raises(ValueError, match="no split"):
        run_text_job(spark, {"encoding": {**encoding, "splits": ["absent"]}})
    with pytest.raises(ValueError, match="vocab_sizes"):
        run_text_job(spark, {"bpe_training": {**training, "vocab_sizes": []}})
    with pytest.raises(ValueError, match="unknown sections"):
        run_text_job(spark, {"training": {}})
