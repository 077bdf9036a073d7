"""Lookup and static tables from CSV (plain or gzip) or an existing DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ORDER = "_row_order"

_TYPES = {
    "string": "string", "str": "string", "utf8": "string",
    "int": "bigint", "int64": "bigint", "integer": "bigint",
    "float": "double", "float64": "double",
}


def read_table(
    spark: SparkSession, source: str | DataFrame, dtypes: dict[str, str] | None = None
) -> DataFrame:
    """Rows with ``ROW_ORDER``, their place in the file (first and last row rules need it).

    A DataFrame is ordered by its ``file_order`` column where it has one.
    """
    kinds = {name: _TYPES.get(str(kind).lower(), kind) for name, kind in (dtypes or {}).items()}
    if isinstance(source, str):
        inferred = spark.read.csv(source, header=True, inferSchema=True)
        # Cells of typed columns are read as text, so ids keep their leading zeros.
        df = spark.read.csv(source, header=True) if kinds else inferred
        cells = [F.col(f.name).cast(kinds.get(f.name, f.dataType)).alias(f.name) for f in inferred.schema]
        place = df.select("*", "_metadata.file_path", "_metadata.file_block_start").withColumn(
            "_n", F.monotonically_increasing_id()
        )
        return place.select(*cells, F.struct("file_path", "file_block_start", "_n").alias(ROW_ORDER))
    df = source
    for name, kind in kinds.items():
        df = df.withColumn(name, F.col(name).cast(kind))
    if "file_order" in df.columns:
        return df.withColumn(ROW_ORDER, F.struct("file_order")).drop("file_order")
    return df.withColumn(ROW_ORDER, F.struct(F.monotonically_increasing_id().alias("n")))
