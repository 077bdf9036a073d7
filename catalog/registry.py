"""Query functions with the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import Fixtures
from eventloom.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def stage_path(f: Fixtures, name: str) -> str:
    return f"{run_folder(f.spark)}/{name}-{uuid.uuid4().hex}"


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Events for comparison: times as microseconds, untimed as null."""
    t = F.unix_micros("time").alias("t_us")
    return df.select(*[t if c == "t_us" else F.col(c) for c in columns])


EVENT = ("subject_id", "t_us", "code", "numeric_value", "text_value")
EVENT_SQL = "subject_id, epoch_us(time) AS t_us, code, numeric_value, text_value"


def joined(column: str) -> F:
    """An array column as text, for comparison."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "|").alias(column)
