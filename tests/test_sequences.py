"""Sequences in blocks against one row per subject."""

import pytest
from pyspark.sql import functions as F

from eventloom.ordering import LIMIT_KEY, ROW_LIMIT_KEY
from eventloom.plans.timelines import TimelineRun
from eventloom.sources.sequences import write_sequences
from tests.test_streaming import MAIN


@pytest.fixture
def stored(spark, fixtures, tmp_path):
    """Whole timelines, and a store whose subjects above 20 events are cut."""
    events = fixtures.events().drop("split")
    run = TimelineRun.from_config(MAIN)
    run.train(run.fit(events).tokens(events))
    whole = {r.subject_id: (r.tokens, r.timestamps) for r in run.encode(run.tokens(events)).collect()}
    spark.conf.set(LIMIT_KEY, "20")
    try:
        rows = run.tokens(events)
        yield whole, write_sequences(run.tokenizer, rows, f"{tmp_path}/store"), run, rows
    finally:
        spark.conf.unset(LIMIT_KEY)


def together(rows):
    rows = sorted(rows, key=lambda r: r.offset)
    return [t for r in rows for t in r.tokens], [t for r in rows for t in r.timestamps]


def test_blocks_put_together_are_the_whole(spark, stored):
    whole, store, _, _ = stored
    found = {}
    for row in store.all().collect():
        found.setdefault(row.subject_id, []).append(row)
    assert {s: together(rows) for s, rows in found.items()} == whole
    longest = max(whole, key=lambda s: len(whole[s][0]))
    blocks = found[longest]
    assert len(blocks) > 3 and max(len(r.tokens) for r in blocks) < len(whole[longest][0]) / 2
    assert sorted(r.offset for r in blocks)[0] == 0


def test_ranges_open_the_blocks_that_overlap(spark, stored):
    whole, store, _, _ = stored
    longest = max(whole, key=lambda s: len(whole[s][0]))
    tokens, times = whole[longest]
    n = len(tokens)
    for start, stop in ((0, 1), (0, n), (n // 3, n // 2), (n - 1, n + 50), (7, None), (n, None), (5, 5)):
        rows = store.read(longest, start, stop).collect()
        assert together(rows) == (tokens[start:stop], times[start:stop])
    offsets = {r.offset: r.n for r in store.offsets().where(F.col("subject_id") == longest).collect()}
    assert store.read(longest, 0, 1).count() == 1 < len(offsets)
    assert together(store.walk(longest)) == (tokens, times)
    short = min(whole, key=lambda s: len(whole[s][0]))
    assert together(store.read(short).collect()) == whole[short]
    assert store.read(-7).count() == 0 and list(store.walk(-7)) == []


def test_one_row_refuses_what_it_should_not_hold(spark, stored):
    whole, _, run, rows = stored
    longest = max(whole, key=lambda s: len(whole[s][0]))
    spark.conf.set(ROW_LIMIT_KEY, str(len(whole[longest][0]) - 1))
    try:
        with pytest.raises(ValueError, match=f"subject_id {longest} has {len(whole[longest][0])} items"):
            run.encode(rows)
    finally:
        spark.conf.unset(ROW_LIMIT_KEY)
    assert {r.subject_id: (r.tokens, r.timestamps) for r in run.encode(rows).collect()} == whole


def test_an_empty_store(spark, stored, tmp_path):
    _, _, run, rows = stored
    none = rows.with_df(rows.df.where("false"))
    assert write_sequences(run.tokenizer, none, f"{tmp_path}/none").all().count() == 0
