"""Operators over a subject's ordered events.

The long table stays long: one row per event with the columns that order it.
``slot`` orders rows made from one event (a gap token precedes its event).
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.gaps import LADDERS, LEAST_GAP, configured_gap, cut_ranges
from eventloom.functions.prefixes import with_first_prefix
from eventloom.functions.text import part, title_text
from eventloom.operators.base import value_text
from eventloom.operators.filters import as_flag
from eventloom.ordering import Ordered, last_before, next_value, order_groups, reorder
from eventloom.schema import BIRTH, epoch_us, subject_keys
from eventloom.sources.tables import ROW_ORDER, read_table

BASE_ORDER = ["t_us", "seq", "slot"]
EVENT_SLOT = 1


def sequence_rows(events: DataFrame) -> DataFrame:
    """Events with their values as text and the columns that order them."""
    return events.withColumns(
        {
            "t_us": epoch_us(),
            "slot": F.lit(EVENT_SLOT),
            "numeric_value": value_text(events, "numeric_value"),
            "text_value": value_text(events, "text_value"),
        }
    )


def build_sequence(events: DataFrame, source: DataFrame | None = None) -> Ordered:
    """Order each subject's events by time (untimed first), then source order.

    ``source``: the table ``events`` were derived from, to count rows per subject.
    """
    df = sequence_rows(events)
    return order_groups(df, subject_keys(events), BASE_ORDER, source)


class SequenceOperator:
    def apply(self, rows: Ordered) -> Ordered:
        raise NotImplementedError


class TimeIntervals(SequenceOperator):
    """A token before an event that names the gap to the previous timed event.

    A birth is not "previous" unless a token was placed before it: that token
    carries the birth's time.
    """

    def __init__(
        self,
        interval_tokens: dict[str, dict] | None = None,
        use_dynamic_bucketing: bool | str = False,
        wrap_token: bool | str = True,
        dataset: str = "CPRD",
        unwrapped_prefix: str = "",
    ):
        self.dynamic = as_flag(use_dynamic_bucketing)
        self.wrap = as_flag(wrap_token)
        self.dataset = (dataset or "CPRD").strip().upper()
        if self.dataset not in LADDERS:
            raise ValueError(f"no gap ladder for {dataset!r}; known: {', '.join(LADDERS)}")
        if not self.dynamic and not interval_tokens:
            raise ValueError("interval_tokens are needed without dynamic bucketing")
        self.intervals = interval_tokens or {}
        self.unwrapped_prefix = unwrapped_prefix

    def gap_name(self, gap: Column) -> Column:
        if self.dynamic:
            return F.when(gap > 0, LADDERS[self.dataset](gap))
        return configured_gap(gap, self.intervals)

    def token(self, gap: Column) -> Column:
        name = self.gap_name(gap)
        if self.wrap:
            return F.concat(F.lit("<time_interval_"), name, F.lit(">"))
        return F.concat(F.lit(self.unwrapped_prefix if self.dynamic else ""), name)

    def named(self) -> Callable[[int], bool]:
        """Whether a gap in microseconds has a name, as plain Python."""
        if self.dynamic:
            least = LEAST_GAP[self.dataset]
            return lambda gap: gap >= least
        starts, names = cut_ranges(self.intervals)
        return lambda gap: gap >= starts[0] and names[bisect.bisect_right(starts, gap) - 1] is not None

    def apply(self, rows: Ordered) -> Ordered:
        timed = F.when(F.col("time").isNotNull(), F.col("t_us"))
        birth = F.coalesce(F.col("code") == BIRTH, F.lit(False))
        rows = last_before(rows, F.when(~birth, timed), "_seen")
        marked = birth & self.gap_name(timed - F.col("_seen")).isNotNull()
        rows = last_before(rows, F.when(~birth | marked, timed), "_seen")
        return rows.with_df(self.with_gaps(rows.df))

    def with_gaps(self, df: DataFrame) -> DataFrame:
        """Gap rows before the events of ``df``; ``_seen`` is the time of the event before, and goes."""
        columns = [c for c in df.columns if c != "_seen"]
        timed = F.when(F.col("time").isNotNull(), F.col("t_us"))
        gap_row = {
            "code": self.token(timed - F.col("_seen")),
            "numeric_value": F.lit(None).cast("string"),
            "text_value": F.lit(None).cast("string"),
            "unit": F.lit(None).cast("string"),
            "slot": F.lit(EVENT_SLOT - 1),
        }
        kept = ["code", "numeric_value", "text_value", "unit", "slot"]
        event = F.struct(*kept)
        gap = F.struct(*[gap_row[c].alias(c) for c in kept])
        both = F.when(gap["code"].isNotNull(), F.array(gap, event)).otherwise(F.array(event))
        others = [c for c in columns if c not in kept]
        return df.select(*others, F.explode(both).alias("row")).select(*others, "row.*").select(columns)


class DemographicSortOrder(SequenceOperator):
    """Untimed events first, by the first pattern that starts their text, else their code."""

    def __init__(self, token_patterns: list[str]):
        self.patterns = list(dict.fromkeys(token_patterns))

    def apply(self, rows: Ordered) -> Ordered:
        untimed = F.col("time").isNull()
        df = rows.df
        for column in ("code", "text_value"):
            # A column of its own: inside the test of every pattern the generated method is too long to be compiled.
            df = df.withColumn("_looked_at", F.when(untimed & (F.col(column) != ""), F.col(column)))
            df = with_first_prefix(df, F.col("_looked_at"), self.patterns, f"_{column}_place").drop("_looked_at")
        # Text wins over code.
        place = F.coalesce("_text_value_place", "_code_place", F.lit(len(self.patterns)))
        df = df.withColumns(
            {
                "rank": F.when(untimed, place),
                "rank_text": F.when(untimed, F.coalesce("text_value", F.lit(""))),
                "rank_code": F.when(untimed, F.coalesce("code", F.lit(""))),
            }
        ).drop("_text_value_place", "_code_place")
        # Untimed rows share one t_us, so the ranks only order among themselves.
        return reorder(rows, df, ["t_us", "rank", "rank_text", "rank_code", "seq", "slot"])


class RemoveNumeric(SequenceOperator):
    """Drop events whose numeric or text value is nothing but a plain number."""

    PATTERN = r"^-?\d+\.?\d*$"

    def apply(self, rows: Ordered) -> Ordered:
        def plain(column: str) -> Column:
            return F.coalesce(F.trim(column).rlike(self.PATTERN), F.lit(False))

        return rows.with_df(rows.df.where(~plain("numeric_value") & ~plain("text_value")))


BIN_LABELS = ["low", "normal", "high", "very low", "very high"]
THREE_LABELS = ["low", "normal", "high"]


class NaturalLanguageTranslation(SequenceOperator):
    """Codes to phrases, with a bin label merged into the phrase of its measurement.

    ``bin_source="value"`` takes the label from the event's own value, where the
    binning operators put it; ``"next_code"`` from the code of the next event,
    which is then consumed. Lookups are CSV paths or DataFrames.

    An event without a code has no phrase and goes, and so does a label that stands as a
    code of its own; a null code after a measurement is no label for it.
    """

    def __init__(
        self,
        medical_lookup_filepath1: str | DataFrame,
        medical_lookup_filepath2: str | DataFrame,
        lab_lookup_filepath: str | DataFrame,
        region_lookup_filepath: str | DataFrame,
        bin_source: str = "value",
    ):
        if bin_source not in ("value", "next_code"):
            raise ValueError("bin_source must be 'value' or 'next_code'")
        self.medical1 = medical_lookup_filepath1
        self.medical2 = medical_lookup_filepath2
        self.labs = lab_lookup_filepath
        self.regions = region_lookup_filepath
        self.bin_source = bin_source

    def _terms(self, df: DataFrame) -> DataFrame:
        """One table for all four lookups: ``key`` is the kind and the upper-cased code."""
        spark = df.sparkSession
        sources = [
            ("1", self.medical1, "code", "term"), ("2", self.medical2, "code", "term"),
            ("L", self.labs, "code", "term"), ("R", self.regions, "regionid", "Description"),
        ]
        terms = None
        for kind, source, code, term in sources:
            part_ = term_lookup(read_table(spark, source), code, term).select(
                F.concat(F.lit(kind), "code").alias("key"), "term"
            )
            terms = part_ if terms is None else terms.unionByName(part_)
        return terms

    def apply(self, rows: Ordered) -> Ordered:
        columns = rows.df.columns
        code = F.col("code")
        measured = F.lit(False)
        for prefix in ("LAB//", "MEASUREMENT//", "MEDICAL//BMI", "MEDICAL//bp_"):
            measured = measured | code.startswith(prefix)
        measured = F.coalesce(measured, F.lit(False))
        if self.bin_source == "next_code":
            rows = next_value(rows, code, "_next")
            rows = last_before(rows, measured, "_measured_before")
            is_label = F.coalesce(code.isin(BIN_LABELS), F.lit(False))
            consumed = is_label & F.coalesce("_measured_before", F.lit(False))
            df = rows.df.withColumn("_bin", F.when(measured & F.col("_next").isin(BIN_LABELS), F.col("_next")))
            df = df.where(~consumed)
        else:
            own = F.coalesce(
                F.when(F.col("numeric_value").isin(BIN_LABELS), F.col("numeric_value")),
                F.when(F.col("text_value").isin(BIN_LABELS), F.col("text_value")),
            )
            df = rows.df.withColumn("_bin", F.when(measured, own))
        raw = F.upper(part(code, 1))
        medical = code.startswith("MEDICAL//") | code.startswith("MEASUREMENT//")
        df = df.withColumns(
            {
                "_raw": raw,
                "_k1": F.when(medical, F.concat(F.lit("1"), raw)),
                "_k2": F.when(medical, F.concat(F.lit("2"), raw))
                .when(code.startswith("LAB//"), F.concat(F.lit("L"), raw))
                .when(code.startswith("REGION//"), F.concat(F.lit("R"), part(code, 1))),
            }
        )
        terms = self._terms(df)
        # Rows without a key keep a spread one of their own.
        spare = F.concat(F.lit("\u0000"), F.coalesce(code, F.lit("")))
        for key, name in (("_k1", "_t1"), ("_k2", "_t2")):
            df = df.withColumn(key, F.coalesce(key, spare))
            df = df.join(terms.select(F.col("key").alias(key), F.col("term").alias(name)), key, "left")
        df = df.withColumn("code", self.phrase()).where("code is not null")
        return rows.with_df(df.select(columns))

    def phrase(self) -> Column:
        code, raw, label = F.col("code"), F.col("_raw"), F.col("_bin")
        fallback = title_text(F.replace(raw, F.lit("_"), F.lit(" ")))
        clinical = F.coalesce("_t1", "_t2", fallback)
        lab = F.coalesce("_t2", fallback)
        three = F.coalesce(label.isin(THREE_LABELS), F.lit(False))

        def binned(description: Column, when: Column) -> Column:
            tagged = F.concat(F.lit("<EVT> "), description, F.lit(" "), label)
            return F.when(when, tagged).otherwise(description)

        concept = part(code, 1)
        bmi = F.when(label.isin(BIN_LABELS), F.concat(concept, F.lit(" "), label)).otherwise(concept)
        pressure = three & F.lower(code).contains("bp_")
        region = F.concat(F.lit("REGION "), F.coalesce("_t2", concept))
        interval = F.substring_index(code, "_", -1)
        return (
            F.when(code.startswith("<time_interval_"), F.trim(interval, F.lit(">")))
            .when(code.startswith("AGE: "), code)
            .when(code.startswith("MEDICAL//BMI"), bmi)
            .when(code.startswith("MEDICAL//"), binned(clinical, pressure))
            .when(code.startswith("MEASUREMENT//"), binned(clinical, three))
            .when(code.startswith("LAB//"), binned(lab, three))
            .when(
                code.startswith("GENDER//") | code.startswith("ETHNICITY//"),
                F.concat(part(code, 0), F.lit(" "), concept),
            )
            .when(code.startswith("REGION//"), region)
            .when(code.rlike(r"^Q\d{1,3}$"), F.concat(F.lit("Quantile "), F.substring(code, F.lit(2), F.lit(3))))
            .when(code.isin(BIN_LABELS), F.lit(None))
            .otherwise(code)
        )


def term_lookup(table: DataFrame, code: str = "code", term: str = "term") -> DataFrame:
    """``code -> term`` with upper-cased codes; of duplicates the last in file order."""
    return (
        table.select(F.upper(F.col(code).cast("string")).alias("code"), F.col(term).alias("term"), ROW_ORDER)
        .where(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.max_by("term", ROW_ORDER).alias("term"))
    )
