"""Counts kept per shard and merged: a refit reads the shards that came since.

``ShardCounts`` stores, for every file of a folder, how often each of the counted rows occurs in it.
``update`` counts files that are new or were written again; ``merged`` adds up what is stored of the
files that are there now. A manifest says which update counted a file: it is written last, so an update
that fails leaves nothing behind that counts.

What is counted is a function of events: codes, values per operator and code, or tokens of a fitted
run. Tokens need shards of whole subjects, as the run that makes them does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.quantiles import exact_quantiles
from eventloom.operators.base import CodeOperator, Operator, value_number
from eventloom.operators.values import PerCodeEdges
from eventloom.plans.chain import apply_operators
from eventloom.plans.timelines import TimelineRun
from eventloom.schema import SCHEME, event_table
from eventloom.session import materialize
from eventloom.sources.events import path_exists

FILE = "_file"
_MANIFEST = "file string, length long, modified timestamp"


def _plain(path: str):
    """Paths are listed as ``file:///a`` and shown as ``file:/a``."""
    return F.regexp_replace(path, SCHEME, "$1:/")


@dataclass(frozen=True)
class Update:
    """What an update read."""

    files: int
    rows: int


class ShardCounts:
    """Counts of the Parquet shards under ``shards``, stored at ``path``.

    ``counted`` turns events, which carry ``_file``, into the rows to count, which still carry it.
    """

    def __init__(self, spark: SparkSession, shards: str, path: str, counted: Callable[[DataFrame], DataFrame]):
        self.spark, self.shards, self.path, self.counted = spark, shards.rstrip("/"), path.rstrip("/"), counted

    def listed(self) -> DataFrame:
        """Files that are there now. Their contents are not read."""
        if not path_exists(self.spark, self.shards):
            return self.spark.createDataFrame([], _MANIFEST)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.shards)
        return files.select(_plain("path").alias("file"), "length", F.col("modificationTime").alias("modified"))

    def manifest(self) -> DataFrame:
        """Counted files, each as it was when it was counted last."""
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], _MANIFEST + ", update int")
        rows = self.spark.read.schema(_MANIFEST + ", update int").parquet(f"{self.path}/manifest")
        last = rows.groupBy("file").agg(F.max_by(F.struct("length", "modified", "update"), "update").alias("last"))
        return last.select("file", "last.*")

    def update(self) -> Update:
        """Count the files that the manifest does not have as they are."""
        known = self.manifest()
        fresh = materialize(self.listed().join(known.drop("update"), ["file", "length", "modified"], "left_anti"), "fresh-shards")
        # A scan lists its files on the driver in any case.
        files = [row["file"] for row in fresh.select("file").collect()]
        if not files:
            return Update(0, 0)
        number = known.agg(F.coalesce(F.max("update") + 1, F.lit(0))).first()[0]
        rows = self.spark.read.option("basePath", self.shards).parquet(*files)
        rows = rows.select("*", _plain("_metadata.file_path").alias(FILE))
        seen = Observation()
        events = event_table(rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0))).observe(seen, F.count(F.lit(1)).alias("rows"))
        counted = self.counted(events)
        counts = counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/update={number}")
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/update={number}")
        return Update(len(files), seen.get["rows"])

    def merged(self) -> DataFrame:
        """The counted rows of all files that are there now, with their number ``n``."""
        current = self.manifest().join(self.listed(), ["file", "length", "modified"], "left_semi").select(F.col("file").alias(FILE), "update")
        counts = self.spark.read.parquet(f"{self.path}/counts").join(current, [FILE, "update"], "left_semi")
        keys = [c for c in counts.columns if c not in (FILE, "update", "n")]
        return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def codes(events: DataFrame) -> DataFrame:
    """Count codes: for ``TopKCodes.fit_counts`` and reports."""
    return events.select(FILE, "code")


def values_of(operators: list[Operator]) -> Callable[[DataFrame], DataFrame]:
    """Count the values that the chain's bins learn from, their codes rewritten as by the whole chain."""
    learners = [op for op in operators if isinstance(op, PerCodeEdges)]
    rewriting = [op for op in operators if isinstance(op, CodeOperator)]

    def counted(events: DataFrame) -> DataFrame:
        events = apply_operators(rewriting, events)
        hits = []
        for i, op in enumerate(learners):
            number = value_number(events, op.value_column)
            hits.append(F.when(op.matches() & number.isNotNull(), F.struct(F.lit(i).alias("op"), number.alias("value"))))
        return events.select(FILE, "code", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(FILE, "code", "hit.*")

    return counted


def fit_values(operators: list[Operator], counts: DataFrame) -> None:
    """Fit the chain's bins on merged counts of ``values_of``."""
    for i, op in enumerate(op for op in operators if isinstance(op, PerCodeEdges)):
        edges = exact_quantiles(counts.where(F.col("op") == i), ["code"], "value", op.probabilities, weight="n")
        op.fitted = materialize(edges, "code-edges")


def tokens_of(run: TimelineRun) -> Callable[[DataFrame], DataFrame]:
    """Count the tokens of a fitted run, for ``WordLevel.train_counts`` and ``BytePairTokens.train_words``."""

    def counted(events: DataFrame) -> DataFrame:
        # The file goes with the subject, of which a shard holds all.
        of_file = events.select("subject_id", FILE).distinct()
        rows = run.tokens(events.drop(FILE))
        return rows.df.where("token is not null").select("subject_id", "token").join(of_file, "subject_id").select(FILE, "token")

    return counted
