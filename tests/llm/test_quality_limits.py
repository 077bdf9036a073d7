"""Thresholds of the quality stage: documents the model has not seen, rare languages, short trusted texts."""

import random

from eventloom.llm import quality


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def vocabulary(rng, letters, n=400):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)]


def judged(spark, rows, trusted):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    return {r["doc_id"]: r["keep"] for r in quality.classify(df, ids, held_out=True).collect()}


def test_clean_documents_outside_the_labels_stay(spark):
    rng = random.Random(1)
    de, fr, xx = (vocabulary(rng, letters) for letters in ("abcdeghinrstu", "aeioulmnprst", "kqwzyxvjo"))
    rows = [(i, prose(rng, de, 150), "de") for i in range(60)] + [(100 + i, prose(rng, fr, 150), "fr") for i in range(60)]
    rows += [(200 + i, prose(rng, xx, 150), "xx") for i in range(10)] + [(300, prose(rng, xx, 150), None)]
    rows += [(400 + i, "#@!%^ 0x" * 100, "de") for i in range(5)]
    keep = judged(spark, rows, [*range(30), *range(100, 130)])
    assert sum(not keep[i] for i in [*range(60), *range(100, 160)]) <= 2
    assert all(keep[i] for i in [*range(200, 210), 300])
    assert not any(keep[400 + i] for i in range(5))


def test_short_trusted_texts_do_not_loosen_the_limit(spark):
    rng = random.Random(2)
    de, other = vocabulary(rng, "abcdeghinrstu"), vocabulary(rng, "abcdeghinrstu")
    mixed = [*de, *other[:100]]
    rows = [(i, prose(rng, de, 150), "de") for i in range(80)] + [(100 + i, rng.choice(de).title() + ".", "de") for i in range(40)]
    rows += [(200 + i, prose(rng, mixed, 400), "de") for i in range(10)]
    keep = judged(spark, rows, [*range(60), *range(100, 140)])
    assert sum(not keep[i] for i in [*range(80), *range(100, 140)]) <= 1
    assert not any(keep[i] for i in range(200, 210))
