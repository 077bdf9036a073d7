"""Static subject attributes as untimed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.frames import EventFrame
from eventloom.functions.text import float_text, strip
from eventloom.operators.base import Operator
from eventloom.operators.filters import as_flag
from eventloom.schema import NO_CODE, subject_keys
from eventloom.session import materialize
from eventloom.sources.tables import ROW_ORDER, read_table

DEFAULT_VALUE = "UNKNOWN"


def clean_value(raw: Column, config: dict) -> Column:
    """Trim and upper-case, map, then check against the valid values.

    Mapping keys are compared after upper-casing, so a lower-case key never applies.
    """
    default = F.lit(config.get("map_invalids_to", DEFAULT_VALUE))
    text = F.upper(strip(raw))
    mapped = text
    for found, target in reversed(list((config.get("mappings") or {}).items())):
        mapped = F.when(text == str(found), F.lit(str(target))).otherwise(mapped)
    valid = config.get("valid_values")
    if valid is not None:
        mapped = F.when(mapped.isin([str(v) for v in valid]), mapped).otherwise(default)
    return F.when(raw.isNull(), default).otherwise(mapped)


def unmatched_mapping_keys(config: dict) -> list[str]:
    """Mapping keys that can never apply because values are upper-cased first."""
    return [str(k) for k in (config.get("mappings") or {}) if str(k) != str(k).upper()]


class LoadStaticData(Operator):
    """For every subject and configured column one untimed row.

    Subjects without a static row get the column's default; of several static
    rows per subject the first in the file counts.
    """

    inserts = True

    def __init__(
        self,
        csv_filepath: str | DataFrame,
        subject_id_column: str,
        columns: list[dict],
        matching_type: str | None = None,
        matching_value: str | None = None,
    ):
        for config in columns:
            for field in ("column_name", "code_template"):
                if field not in config:
                    raise ValueError(f"Each column configuration must have '{field}'")
        self.source = csv_filepath
        self.subject_id_column = subject_id_column
        self.columns = columns

    def fit(self, train: DataFrame) -> "LoadStaticData":
        table = read_table(train.sparkSession, self.source)
        for name in [self.subject_id_column, *(c["column_name"] for c in self.columns)]:
            if name not in table.columns:
                raise ValueError(f"Column '{name}' not found in the static table: {table.columns}")
        kinds = {f.name: f.dataType for f in table.schema}
        names = list(dict.fromkeys(c["column_name"] for c in self.columns))
        # One aggregate takes the first row of a subject: no window, partial sums first.
        first = table.groupBy(F.col(self.subject_id_column).cast("bigint").alias("subject_id")).agg(
            F.min_by(F.struct(*names), ROW_ORDER).alias("row")
        )
        cleaned = [
            clean_value(_as_text(F.col("row")[c["column_name"]], kinds[c["column_name"]]), c).alias(f"v{i}")
            for i, c in enumerate(self.columns)
        ]
        self.fitted = materialize(first.where("subject_id is not null").select("subject_id", *cleaned), "static")
        return self

    def subjects(self, frame: EventFrame) -> DataFrame:
        """Subjects of the frame, each once, with their static values where known."""
        keys = subject_keys(frame.rows)
        ids = frame.rows.select(*keys)
        for part in frame.inserted:
            ids = ids.unionByName(part.df.select(*keys))
        static = self.fitted.withColumn("_found", F.lit(True))
        return ids.distinct().join(static, "subject_id", "left")

    def apply(self, frame: EventFrame) -> EventFrame:
        rows = []
        codes = set()
        for i, config in enumerate(self.columns):
            prefix = config.get("value_prefix") or ""
            code = config["code_template"] if as_flag(config.get("insert_code", True)) else NO_CODE
            codes.add(code)
            default = config.get("map_invalids_to", DEFAULT_VALUE)
            value = F.when(F.col("_found"), F.col(f"v{i}")).otherwise(F.lit(default))
            rows.append(
                F.struct(
                    F.lit(code).alias("code"),
                    F.concat(F.lit(prefix), value).alias("text_value"),
                    self.inserted_seq(i).alias("seq"),
                )
            )
        keys = subject_keys(frame.rows)
        static = self.subjects(frame).select(*keys, F.explode(F.array(*rows)).alias("row"))
        return frame.insert(static.select(*keys, "row.*"), codes)

    def distribution(self) -> DataFrame:
        """Subjects per cleaned value of every column, with percent of all subjects."""
        cells = [
            F.struct(F.lit(c["column_name"]).alias("column_name"), F.col(f"v{i}").alias("value"))
            for i, c in enumerate(self.columns)
        ]
        counts = (
            self.fitted.select(F.explode(F.array(*cells)).alias("cell"))
            .groupBy("cell.column_name", "cell.value")
            .agg(F.count(F.lit(1)).alias("subjects"))
        )
        # Every subject has one value per column, so a column's counts add up to the subjects.
        totals = counts.groupBy("column_name").agg(F.sum("subjects").alias("total"))
        share = F.round(F.col("subjects") / F.col("total") * 100, 1)
        return counts.join(totals, "column_name").select(
            "column_name", "value", "subjects", share.alias("percent")
        )

    def match_rate(self, events: DataFrame) -> DataFrame:
        """How many event subjects have a static row."""
        found = F.count_if(F.coalesce("_found", F.lit(False)))
        total = F.count(F.lit(1))
        return self.subjects(EventFrame(events)).agg(
            total.alias("subjects"),
            found.alias("found"),
            (total - found).alias("missing"),
            F.when(total > 0, F.round(found / total * 100, 1)).otherwise(0.0).alias("percent"),
        )


def _as_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_text(value.cast("double"))
    return value.cast("string")
