"""Token ids in binary files of fixed-width bit-packed blocks.

Each id takes the bits that the largest id of the vocabulary needs. A file is

    magic "EVLB", version, bits, ids per block        4 x unsigned 32-bit
    documents, ids, blocks                            3 x unsigned 64-bit
    document ids                                      signed 64-bit each
    whether a document id is null                     one byte each
    first id of each document, then the id count      unsigned 64-bit each
    first byte of each block, then the payload size   unsigned 64-bit each
    payload: blocks of packed ids, lowest bit first, each padded to whole bytes

all little-endian. Block offsets give random access: ``read_ids`` touches the
blocks of a range only, and unpacks them with numpy.

Documents are written in ascending ``doc_id`` order (null first; equal ids by
text), over as many files as needed; every task streams its range into files of
bounded size in the shared folder. A file's name is unique to the attempt that
wrote it, and the manifest, itself a written table, names the files of the
attempts that counted: a lost executor costs its tasks, never the result.

Results by case: null and empty texts hold the end id only; an empty table gives
an empty manifest; repeated rows are written each; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import filled, shared_folder, slices, write_once
from eventloom.llm.encode import encoder, with_end

MAGIC = np.frombuffer(b"EVLB", "<u4")[0]
VERSION = 1
BLOCK_IDS = 4096
#: Ids a task gathers before it closes a file.
FILE_IDS = 8 << 20


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, count: int) -> np.ndarray:
    """The inverse of ``pack``, as unsigned 32-bit ids."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return flat.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_file(doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A whole file. ``bounds`` holds the first id of each document and the id count."""
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    out = io.BytesIO()
    out.write(np.array([MAGIC, VERSION, bits, block_ids], "<u4").tobytes())
    out.write(np.array([len(doc_ids), len(ids), len(blocks)], "<u8").tobytes())
    out.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(bounds.astype("<u8").tobytes())
    out.write(offsets.tobytes())
    out.write(b"".join(blocks))
    return out.getvalue()


class IdFile:
    """Random access to one file. ``source`` is any seekable binary file."""

    def __init__(self, source) -> None:
        self.source = source
        magic, version, self.bits, self.block_ids = (int(x) for x in np.frombuffer(source.read(16), "<u4"))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token id file of this version")
        n_docs, self.n_ids, n_blocks = (int(x) for x in np.frombuffer(source.read(24), "<u8"))
        ids = np.frombuffer(source.read(8 * n_docs), "<i8")
        nulls = np.frombuffer(source.read(n_docs), np.uint8)
        self.doc_ids = [None if null else int(d) for d, null in zip(ids, nulls)]
        self.bounds = np.frombuffer(source.read(8 * (n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(source.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = source.tell()

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading their blocks only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(self.payload + int(self.offsets[first]))
        data = memoryview(self.source.read(int(self.offsets[last + 1] - self.offsets[first])))
        parts = []
        for block in range(first, last + 1):
            low = int(self.offsets[block] - self.offsets[first])
            count = min(self.block_ids, self.n_ids - block * self.block_ids)
            parts.append(unpack(data[low : low + int(self.offsets[block + 1] - self.offsets[block])], self.bits, count))
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.read_ids(int(self.bounds[i]), int(self.bounds[i + 1]))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_MANIFEST = "path string, first_doc long, last_doc long, n_docs long, n_ids long, part int, file int"


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents' ids; the manifest: one row per file with ``start``, the ids of all files before it."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    bits = bits_for(vocabulary)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _filesystem(folder)
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        gathered = number = 0

        def close() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            path = f"{root}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.bits"
            with store.open_output_stream(path) as out:
                out.write(encode_file(doc_ids, bounds, np.concatenate(parts), bits))
            row = {"path": path, "first_doc": doc_ids[0], "last_doc": doc_ids[-1], "n_docs": len(doc_ids), "n_ids": int(bounds[-1]), "part": part, "file": number}
            kinds = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("part", pa.int32()), ("file", pa.int32())])
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in slices(batches):
            ids, bounds = with_end(*words.encode(batch.column("text")), end_id)
            doc_ids += batch.column("doc_id").to_pylist()
            counts.append(np.diff(bounds))
            parts.append(ids)
            gathered += len(ids)
            if gathered >= file_ids:
                yield close()
                doc_ids, counts, parts, gathered, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = write_once(ordered.mapInArrow(files, _MANIFEST), "token-id-manifest")
    # One row per file of millions of ids: a running sum over them is small at any size of the corpus.
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    return starts.withColumn("root", F.lit(folder))


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: its place among all ids, its length and the checksum of its ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = _filesystem(row["root"])
                with store.open_input_file(row["path"]) as source:
                    file = IdFile(source)
                    ids = file.read_ids(0, file.n_ids).astype("<u4")
                bounds = file.bounds
                checks = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), pa.array(checks, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("root", "path", "start").repartition(F.col("path"))
    return files.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
