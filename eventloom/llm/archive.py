"""A content-addressed WARC archive: payloads once by digest, exact record headers apart.

1. Every page's payload gets its SHA-256. The pages of a digest agree on one response, the one with
   the largest id; the choice is an aggregate over small columns, so copies never meet in one task.
2. The payload store holds the bytes of each digest once. Copies are combined before the shuffle, and
   a second hash must agree over all of them. The store and the headers of responses are bucketed
   and sorted by digest, so that putting records together needs no further shuffle of payloads.
3. A record's header (WARC fields, blank line, HTTP header) is stored as exact bytes. The record of a
   response is its header joined with its payload; a revisit's record is its header alone.
4. Reading back parses the records, checks lengths, recomputes both digests and joins revisits with
   the facts of their response. ``restore`` joins every header with its payload.

``write_warc`` and ``read_warc`` turn records into files of one gzip member each and back.

Results by case: a null html is the empty payload; a null ``page_id`` counts as less than any other; of
rows with the largest id, the one with the largest url is the response, and of equal rows the first
copy; payloads under ``least_bytes`` are all responses, stored once all the same; line breaks in a url
are escaped, a null url leaves its field out; an empty table gives an empty archive; other columns are
ignored. One payload must fit a row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.checksums import base32_sql
from eventloom.llm.common import shared_folder, slices, write_once

LEAST_BYTES = 0
CAPTURED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Pages that share one copy of a payload while payloads are restored.
PART_PAGES = 100_000
#: Bytes of records that a task gathers in one file.
FILE_BYTES = 256 << 20


@dataclass(frozen=True)
class Archive:
    """``payloads``: digest, payload. ``responses`` and ``revisits``: page_id, digest, header."""

    payloads: DataFrame
    responses: DataFrame
    revisits: DataFrame


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")


def _base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits; ``conv`` writes base 32 with the digits 0 to V."""
    digits = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame) -> DataFrame:
    """One row per distinct page row, without payloads, with its copies. A written table."""
    payload = _payload()
    small = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"), _base32(F.sha1(payload)).alias("sha1"),
    )
    return write_once(small.groupBy(*small.columns).agg(F.count(F.lit(1)).alias("copies")), "captures")


def _records(found: DataFrame, least_bytes: int) -> DataFrame:
    """One row per page row: its type, and the response it refers to."""
    response = found.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"))
    joined = found.join(response, "digest")
    is_first = F.col("first").eqNullSafe(F.struct("page_id", "url"))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return each.withColumn("is_response", (F.col("n_bytes") < least_bytes) | (is_first & (F.col("copy") == 0)))


def _record_id(page_id: Column, url: Column, copy: Column) -> Column:
    key = F.substring(F.md5(F.concat("digest", F.coalesce(url, F.lit("")))), 1, 16)
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), key, F.lit(":"), copy.cast("string"), F.lit(">"))


def _header(captured: str) -> Column:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(F.col("is_response"), F.col("n_bytes")).otherwise(0)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("first.page_id"), F.col("first.url"), F.lit(0)), F.lit("\r\n"))
    fields = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("is_response"), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url"), F.col("copy")),
        F.lit(f"\r\nWARC-Date: {captured}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\n"),
        F.when(F.col("is_response"), "").otherwise(refers),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(fields, http), "UTF-8")


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder in buckets of ``digest``, sorted: joins of two such tables need no exchange."""
    spark = df.sparkSession
    label = f"eventloom_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{shared_folder(spark)}/{label}")
    writer.format("parquet").saveAsTable(label)
    return spark.table(label)


def store(pages: DataFrame, least_bytes: int = LEAST_BYTES, captured: str = CAPTURED) -> Archive:
    """Write the archive of all pages."""
    records = _records(captures(pages), least_bytes).withColumn("header", _header(captured))
    kept = ["page_id", "digest", "header"]
    responses = _bucketed(records.where("is_response").select(*kept).repartition("digest"), "responses")
    revisits = write_once(records.where("not is_response").select(*kept), "revisits")
    bytes_of = pages.select(F.sha2(_payload(), 256).alias("digest"), _payload().alias("payload"))
    bytes_of = bytes_of.withColumn("check", F.xxhash64("payload"))
    once = bytes_of.groupBy("digest").agg(F.any_value("payload").alias("payload"), F.min("check").alias("low"), F.max("check").alias("high"))
    agreed = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under "), "digest")))
    payloads = _bucketed(once.select("digest", agreed.alias("payload")), "payloads")
    return Archive(payloads, responses, revisits)


def response_records(archive: Archive) -> DataFrame:
    """``page_id``, ``digest`` and exact ``record`` bytes of all responses."""
    joined = archive.responses.join(archive.payloads.hint("merge"), "digest")
    return joined.select("page_id", "digest", F.concat("header", "payload", F.lit(END)).alias("record"))


def revisit_records(archive: Archive) -> DataFrame:
    return archive.revisits.select("page_id", "digest", F.concat("header", F.lit(END)).alias("record"))


def restore(archive: Archive) -> DataFrame:
    """Every page's payload, those of revisits included: headers joined with payloads.

    A payload of very many pages is copied once for every ``PART_PAGES`` of them, so that they are many tasks.
    """
    kept = ["page_id", "digest", "header"]
    headers = archive.responses.select(*kept).unionByName(archive.revisits.select(*kept))
    # All pages divided by PART_PAGES bound the number of such payloads.
    counts = headers.groupBy("digest").count().where(F.col("count") > PART_PAGES)
    parts = F.broadcast(counts.select("digest", F.ceil(F.col("count") / PART_PAGES).cast("int").alias("parts")))
    n = F.coalesce("parts", F.lit(1))
    dealt = headers.join(parts, "digest", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "header"), n).cast("int"))
    copied = archive.payloads.join(parts, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.join(copied.drop("parts"), ["digest", "part"]).select("page_id", "digest", "payload")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields, HTTP header and payload of a record; its lengths are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if not version.startswith("WARC/") or len(rest) != length + len(END) or rest[length:] != END:
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return fields, http, payload


_FACTS = pa.schema([
    ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
])
_FACTS_SQL = "page_id long, digest string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page_of(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return None if page == "null" else int(page)


def _facts(row: dict) -> dict:
    fields, http, payload = parse_record(row["record"])
    stated = int(http.rpartition(b"Content-Length: ")[2])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), sha1, hashlib.sha256(payload).hexdigest()) != (stated, named, row["digest"]):
            raise ValueError(f"payload and header of {fields['WARC-Record-ID']} disagree")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "digest": row["digest"], "payload_bytes": stated, "payload_digest": named,
        "record_type": fields["WARC-Type"], "refers_to": None if refers is None else _page_of(refers),
    }


def parse(records: DataFrame) -> DataFrame:
    """What records say of themselves; a response whose payload does not match raises."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "record"):
                yield pa.RecordBatch.from_pylist([_facts(row) for row in part.to_pylist()], _FACTS)

    return records.select("digest", "record").mapInArrow(facts, _FACTS_SQL)


def read_back(archive: Archive) -> DataFrame:
    """One row per page from the records: size and digest of its payload, type, and the response it refers to."""
    found = write_once(parse(response_records(archive)), "responses-read")
    of_payload = found.groupBy("digest").agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_sha1"))
    again = parse(revisit_records(archive)).join(of_payload, "digest")
    same = (F.col("payload_bytes") == F.col("_bytes")) & (F.col("payload_digest") == F.col("_sha1"))
    size = F.when(same, F.col("_bytes")).otherwise(F.raise_error(F.concat(F.lit("a revisit differs from its response: "), "digest")).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*columns).unionByName(again.withColumn("payload_bytes", size).select(*columns))


def write_warc(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Records into files of the shared folder, one gzip member each. The manifest names the files of the attempts that counted."""
    folder = f"{shared_folder(records.sparkSession)}/warc-{uuid.uuid4().hex}"

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for record in batch.column("record"):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(name, compression=None), 0, 0
                member = gzip.compress(record.as_py(), mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]})

    return write_once(records.select("record").mapInArrow(files, "path string, n_records long"), "warc-manifest").withColumn("root", F.lit(folder))


def _members(source) -> Iterator[bytes]:
    """Records of an open file: each begins with its WARC fields, which say how long it is."""
    with gzip.GzipFile(fileobj=source) as stream:
        while True:
            head = b""
            while not head.endswith(b"\r\n\r\n"):
                line = stream.readline()
                if not line:
                    return
                head += line
            length = int(next(line for line in head.decode().split("\r\n") if line.startswith("Content-Length: ")).split(": ")[1])
            yield head + stream.read(length + len(END))


def read_warc(manifest: DataFrame) -> DataFrame:
    """The exact ``record`` bytes of all files."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["root"])
                with store.open_input_file(row["path"]) as source:
                    for record in _members(source):
                        yield pa.RecordBatch.from_pydict({"record": [record]})

    return manifest.select("root", "path").repartition("path").mapInArrow(records, "record binary")


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archive and read it back."""
    return read_back(store(pages, least_bytes))


def oracle(least_bytes: int = LEAST_BYTES) -> str:
    """DuckDB SQL of ``archived``."""
    return f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
n AS (SELECT *, octet_length(payload) AS size, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place,
  first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS first FROM p)
SELECT page_id, size AS payload_bytes, {base32_sql("sha1(payload)")} AS payload_digest,
  CASE WHEN place = 1 OR size < {least_bytes} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place = 1 OR size < {least_bytes} THEN NULL ELSE first END AS refers_to
FROM n"""
