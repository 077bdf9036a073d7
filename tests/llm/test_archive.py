"""The content-addressed archive against the definition, and exact round trips."""

import base64
import hashlib

import pytest

from eventloom.llm import archive

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(table, least=0):
    """Rows of (page_id, url, html)."""
    first = {}
    for i, (page, url, html) in enumerate(table):
        key = (page is not None, page or 0, url is not None, url or "", -i)
        text = html or ""
        first[text] = max(first.get(text, (key, i)), (key, i))
    rows = []
    for i, (page, _, html) in enumerate(table):
        payload = (html or "").encode()
        at = first[html or ""][1]
        response = at == i or len(payload) < least
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        rows.append((page, len(payload), digest, "response" if response else "revisit", None if response else table[at][0]))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(row) for row in df.select(*COLUMNS).collect()), key=str)


def frame(spark, table):
    rows = [(html, page, url, "x", 3) for page, url, html in table]
    return spark.createDataFrame(rows, "html string, page_id long, url string, digest string, copies int")


TABLE = [
    (1, "http://a/1", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (3, "http://a/3", "<p>one</p>"), (4, "http://b", "é日😀\r\n\r\nWARC/1.1"),
    (5, None, None), (6, "http://c\r\nX: y", ""), (None, "http://d", "<p>one</p>"), (None, None, "only nulls"), (None, None, "only nulls"),
    (7, "http://e", "twice"), (7, "http://e", "twice"), (7, "http://f", "twice"), (7, "http://e", "other"), (8, "http://g", "z" * 3_000_000),
]


@pytest.mark.parametrize("least", [0, 6])
def test_records_equal_the_definition(spark, least):
    assert got(archive.archived(frame(spark, TABLE), least)) == expected(TABLE, least)


def test_large_groups_of_copies(spark):
    table = [(i, f"http://h/{i}", "same page") for i in range(500)] + [(3, "u", "again")] * 200
    assert got(archive.archived(frame(spark, table))) == expected(table)


def test_empty_table(spark):
    assert got(archive.archived(frame(spark, []))) == []


def test_payloads_are_stored_once_and_all_pages_come_back(spark):
    kept = archive.store(frame(spark, TABLE))
    assert kept.payloads.count() == len({html or "" for _, _, html in TABLE})
    back = sorted((row.page_id, bytes(row.payload).decode()) for row in archive.restore(kept).where("page_id is not null").collect())
    assert back == sorted((page, html or "") for page, _, html in TABLE if page is not None)


def test_a_payload_of_many_pages_is_restored_in_parts(spark, monkeypatch):
    monkeypatch.setattr(archive, "PART_PAGES", 7)
    table = [(i, f"http://h/{i}", "same page") for i in range(100)] + [(200, "u", "again"), (201, None, None)]
    back = [(row.page_id, bytes(row.payload).decode()) for row in archive.restore(archive.store(frame(spark, table))).collect()]
    assert sorted(back) == sorted((page, html or "") for page, _, html in table)


def test_records_are_joined_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = archive.response_records(archive.store(frame(spark, TABLE)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_records_survive_files(spark):
    kept = archive.store(frame(spark, TABLE))
    records = archive.response_records(kept).unionByName(archive.revisit_records(kept))
    before = sorted(bytes(row.record) for row in records.collect())
    after = sorted(bytes(row.record) for row in archive.read_warc(archive.write_warc(records, file_bytes=200)).collect())
    assert before == after
    for record in before:
        fields, http, payload = archive.parse_record(record)
        assert fields["WARC-Type"] in ("response", "revisit") and http.startswith(b"HTTP/1.1 200 OK")
        assert (fields["WARC-Type"] == "revisit") <= (payload == b"")


def test_a_changed_payload_is_found(spark):
    from pyspark.sql import functions as F

    kept = archive.store(frame(spark, TABLE[:4]))
    broken = archive.Archive(kept.payloads.withColumn("payload", F.concat(F.lit(b"x"), F.substring("payload", 2, 10_000))), kept.responses, kept.revisits)
    with pytest.raises(Exception, match="disagree"):
        archive.read_back(broken).collect()
