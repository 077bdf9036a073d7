"""The pipeline's stages: what they keep, and odd tables through all of them."""

import random

import corpus_pipeline as pipeline
from eventloom.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(rows):
    """Least place of every component of fingerprints at most three bits apart."""
    prints = []
    for _, text in rows:
        hashes = simhash.shingle_hashes((text or "").encode())
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[find(i)][0] for i in range(len(rows))}


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = ["", None, " \n", "one", "One", "a b", "A  b", "a b c d e", "é b c d E", "x " * 40, "x " * 90]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([40, 300, 900]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) if rng.random() < 0.5 else "\n".join(copy).upper())
    return list(enumerate(texts))


def stage(spark, rows):
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS).repartition(4)
    return pipeline.without_near_duplicates(spark, frame, "").collect()


def test_near_copies_go_and_the_least_id_stays(spark):
    rows = corpus()
    found = [r["doc_id"] for r in stage(spark, rows)]
    assert len(found) == len(set(found)) < len(rows) and set(found) == kept(rows)


def test_no_rows_stay_no_rows(spark):
    assert stage(spark, []) == []


def test_null_and_shared_ids_lose_no_rows(spark):
    first, second, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(None, first), (None, second), (7, third), (7, "an entirely different text of the same id"), (None, third), (7, third), (None, first)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stage(spark, rows)) == sorted([(0, first), (0, second), (7, third), (7, rows[3][1])])


def test_each_row_of_an_id_is_judged_by_itself(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30)) + ". " + " ".join(f"a{i}" for i in range(12)) + "."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame([(None, item, "en", "s", 0), (None, "clean", "en", "s", 0), (7, item, "en", "s", 0), (7, "clean too", "en", "s", 0)], COLUMNS)
    left = pipeline.without_benchmarks(spark, frame, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "clean"), (7, "clean too")]


def write_tables(spark, folder, docs, schema):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "some words of an item that nobody holds at all. And an answer.")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_the_whole_pipeline_on_an_empty_table(spark, tmp_path):
    write_tables(spark, tmp_path, [], COLUMNS)
    packed = pipeline.run(spark, str(tmp_path))
    assert packed.count() == 0 and {"doc_id", "ids", "sequence_id", "offset"} <= set(packed.columns)


def test_the_whole_pipeline_with_clashing_columns_and_nulls(spark, tmp_path):
    words = " ".join(f"plain{i} words" for i in range(40))
    docs = [(1, f"{words} one", "en", "s", 1, "x", 2), (None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 2), (1, f"{words} one", "en", "s", 1, "y", 3)]
    write_tables(spark, tmp_path, docs, COLUMNS + ", _row string, length int")
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in packed) in ([0, 1], [1, 2])
