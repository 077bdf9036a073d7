"""Which files of a table may hold a subject: least and greatest id and a Bloom filter per file.

The index is a table of its own. A filter takes ``BITS_PER_KEY`` bits for each subject of its file, in
pages of ``PAGE_BITS`` that are built by bitmap aggregates, so no row and no task holds a large one.
A lookup reads the index rows whose range holds the id, and then only the files whose filter does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 10
#: Bits that a key sets.
HASHES = 7
#: Bits of one bitmap aggregate.
PAGE_BITS = 32_768

_COLUMNS = "file string, keys long, least long, greatest long, pages int, page int, bits binary"


def _places(key: Column, pages: Column) -> list[Column]:
    """The bits of a key in a filter of so many pages."""
    return [F.pmod(F.xxhash64(key.cast("long"), F.lit(i)), pages * F.lit(PAGE_BITS)).cast("long") for i in range(HASHES)]


def describe_files(rows: DataFrame, key: str) -> DataFrame:
    """Index rows of the files that ``rows`` is read from; null keys are not indexed."""
    held = rows.select(F.col("_metadata.file_path").alias("file"), F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    pages = F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / PAGE_BITS).cast("int")
    files = held.groupBy("file").agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("least"), F.max("key").alias("greatest"), pages.alias("pages"))
    bits = held.join(files.select("file", "pages"), "file").select("file", F.explode(F.array(*_places(F.col("key"), F.col("pages")))).alias("place"))
    in_pages = bits.select("file", F.floor(F.col("place") / PAGE_BITS).cast("int").alias("page"), F.pmod("place", F.lit(PAGE_BITS)).alias("bit"))
    maps = in_pages.groupBy("file", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return maps.join(files, "file").select("file", "keys", "least", "greatest", "pages", "page", "bits")


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))).cast("int").bitwiseAND(F.lit(1)) == 1


@dataclass(frozen=True)
class FileIndex:
    """The index at ``path`` over the Parquet files under ``root``."""

    spark: SparkSession
    root: str
    path: str
    key: str = "subject_id"

    def table(self) -> DataFrame:
        return self.spark.read.schema(_COLUMNS).parquet(self.path)

    def build(self) -> "FileIndex":
        """Index all files anew."""
        self._write(describe_files(self.spark.read.parquet(self.root), self.key), "overwrite")
        return self

    def refresh(self) -> int:
        """Index files that came since; how many there were."""
        known = {row["file"] for row in self.table().select("file").distinct().collect()}
        # The scan lists its files on the driver in any case.
        fresh = [f for f in self.spark.read.parquet(self.root).inputFiles() if _plain(f) not in {_plain(k) for k in known}]
        if fresh:
            self._write(describe_files(self._open(fresh), self.key), "append")
        return len(fresh)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Sorted by their least id, so that a lookup's range test skips row groups.
        rows.repartitionByRange("least", "file").sortWithinPartitions("least", "file").write.mode(mode).parquet(self.path)

    def _open(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.root).parquet(*files)

    def files(self, key: int) -> list[str]:
        """Files that may hold a key: those that do, and about one in a hundred of the others in whose range it lies."""
        wanted = F.lit(int(key))
        near = self.table().where((F.col("least") <= wanted) & (F.col("greatest") >= wanted))
        hits = F.lit(0)
        for place in _places(wanted, F.col("pages")):
            here = (F.floor(place / PAGE_BITS) == F.col("page")) & _is_set(F.col("bits"), F.pmod(place, F.lit(PAGE_BITS)))
            hits = hits + here.cast("int")
        full = near.select("file", hits.alias("hits")).groupBy("file").agg(F.sum("hits").alias("hits")).where(F.col("hits") == HASHES)
        return sorted(row["file"] for row in full.collect())

    def read(self, key: int) -> DataFrame:
        """The rows of one key, from the files that may hold it."""
        found = self.files(key)
        if not found:
            return self.spark.read.parquet(self.root).where(F.lit(False))
        return self._open(found).where(F.col(self.key) == F.lit(int(key)))


def _plain(path: str) -> str:
    """Paths are listed as ``file:///a`` and shown as ``file:/a``."""
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else path
