"""What several operators share: tables, written intermediates, bounded Arrow slices."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import eventloom
from eventloom.session import materialize, prepare, scratch_root

#: Text bytes handled at once inside a task; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows sent to Python at once: bounds the buffers when texts are long.
BATCH_ROWS = 512


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: they need no installed copy."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(eventloom.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="eventloom-")) / "eventloom-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for file in sorted(package.rglob("*.py")):
            bundle.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def ready(spark: SparkSession) -> SparkSession:
    """Session options of these operators: UTC, skew handling, small Arrow batches."""
    ship(spark)
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a stable copy that outlives executors."""
    return materialize(df, name)


def shared_folder(spark: SparkSession) -> str:
    return scratch_root(spark)


def filled(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows holding at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and the n + 1 offsets into them. Nulls must be filled before."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``; empty segments give zero."""
    totals = np.concatenate([[0], np.cumsum(values)])
    return totals[bounds[1:]] - totals[bounds[:-1]]
