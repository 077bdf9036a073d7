"""Sequences in blocks, for subjects that no single row should hold.

A subject's tokens are written chunk by chunk, as the tasks that ordered them hold them; an index
says at which position each block begins. Reading a range of positions opens the blocks that overlap
it, and a whole subject can be walked through block by block.

Results by case: an empty table gives an empty store; ordinary subjects are one block; a range beyond
the end gives what there is; subjects that are not there give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators.tokens import assemble_chunks
from eventloom.ordering import Ordered
from eventloom.sources.file_index import FileIndex


def write_sequences(tokenizer, rows: Ordered, path: str, mode: str = "errorifexists") -> "SequenceStore":
    """Encode token rows with a trained tokenizer and store them in blocks."""
    spark = rows.df.sparkSession
    known = rows.with_df(tokenizer.token_ids(rows.df))
    chunks = assemble_chunks(known, F.col("ids"), *tokenizer.edge_ids(), "tokens")
    chunks.write.mode(mode).parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per block: a subject's blocks are few however long it is.
    before = Window.partitionBy(*rows.keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select(*rows.keys, "chunk", F.size("tokens").cast("long").alias("n"))
    index = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index.repartitionByRange("subject_id").sortWithinPartitions("subject_id", "chunk").write.mode(mode).parquet(f"{path}/offsets")
    store = SequenceStore(spark, path)
    store.files().build()
    return store


@dataclass(frozen=True)
class SequenceStore:
    spark: SparkSession
    path: str

    def files(self) -> FileIndex:
        return FileIndex(self.spark, f"{self.path}/blocks", f"{self.path}/files")

    def offsets(self) -> DataFrame:
        """Per block: its subject, ``chunk``, first position and number of tokens."""
        return self.spark.read.parquet(f"{self.path}/offsets")

    def all(self) -> DataFrame:
        """Every block with its ``offset``."""
        blocks = self.spark.read.parquet(f"{self.path}/blocks")
        keys = [c for c in blocks.columns if c not in ("tokens", "timestamps")]
        return blocks.join(self.offsets().drop("n"), keys)

    def _blocks(self, subject_id: int, near: Column) -> DataFrame:
        """Blocks of a subject that ``near`` (a test of the index) picks."""
        picked = self.offsets().where((F.col("subject_id") == int(subject_id)) & near).drop("n")
        keys = [c for c in picked.columns if c != "offset"]
        return self.files().read(subject_id).join(F.broadcast(picked), keys)  # a few rows of one subject

    def read(self, subject_id: int, start: int = 0, stop: int | None = None) -> DataFrame:
        """Tokens and times at positions ``start`` to ``stop`` (exclusive), a row per block, with the first position as ``offset``."""
        near = F.col("offset") + F.col("n") > start
        if stop is not None:
            near = near & (F.col("offset") < stop)
        blocks = self._blocks(subject_id, near)
        skip = F.greatest(F.lit(start) - F.col("offset"), F.lit(0))
        kept = F.size("tokens") - skip if stop is None else F.least(F.lit(stop) - F.col("offset"), F.size("tokens")) - skip
        cut = {name: F.slice(name, (skip + 1).cast("int"), F.greatest(kept, F.lit(0)).cast("int")) for name in ("tokens", "timestamps")}
        return blocks.withColumns({**cut, "offset": F.col("offset") + skip}).where(F.size("tokens") > 0)

    def walk(self, subject_id: int) -> Iterator[Row]:
        """The blocks of a subject in order, one at a time."""
        chunks = [r["chunk"] for r in self.offsets().where(F.col("subject_id") == int(subject_id)).select("chunk").orderBy("chunk").collect()]
        for chunk in chunks:
            yield from self._blocks(subject_id, F.col("chunk") == chunk).toLocalIterator()
