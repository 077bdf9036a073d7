"""Age at the first medical event, as untimed rows.

One aggregate per subject finds the birth and the first real event; the rows it
yields are inserted, birth rows leave unless kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.frames import EventFrame
from eventloom.functions.match import is_real_event
from eventloom.functions.text import fixed_text
from eventloom.operators.base import Operator, is_text, value_text
from eventloom.operators.filters import as_flag, without_birth
from eventloom.schema import BIRTH, NO_CODE, epoch_us, subject_keys

ETHOS_EXCLUDED = ("DEMOGRAPHICS//", "RACE//", "MARITAL_STATUS//")
COMMON_EXCLUDED = ("DEMOGRAPHICS//", "GENDER//", "ETHNICITY//", "REGION//")

SECONDS = {"years": 365.25 * 24 * 3600, "days": 24 * 3600.0, "hours": 3600.0}
_CORE = ("time", "code", "numeric_value", "text_value", "seq")


def births_and_first_events(events: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Per subject with a birth row: its time, its extra columns, and the first real event."""
    keys = subject_keys(events)
    extra = [c for c in events.columns if c not in (*keys, *_CORE)]
    is_birth = F.coalesce(F.col("code") == BIRTH, F.lit(False))
    real = is_real_event(excluded)
    place = F.when(is_birth, F.struct(epoch_us(), F.col("seq")))
    found = (
        events.where(is_birth | real)
        .groupBy(*keys)
        .agg(
            F.min_by(F.struct("time", *extra), place).alias("birth"),
            F.min(F.when(real, F.col("time"))).alias("first_event"),
        )
    )
    return found.where(F.col("birth").isNotNull())


def age_at_first_event(unit: str = "years") -> Column:
    """Age from ``births_and_first_events``; null where a time is missing."""
    passed = F.unix_micros("first_event") - F.unix_micros("birth.time")
    return passed / F.lit(1e6) / F.lit(SECONDS[unit])


class AgeOperator(Operator):
    """Inserts rows derived from the age."""

    inserts = True
    excluded = COMMON_EXCLUDED
    codes: set[str]

    def __init__(self, keep_meds_birth: bool | str = False):
        self.keep_meds_birth = as_flag(keep_meds_birth)

    def aged(self, events: DataFrame) -> DataFrame:
        """Subjects that get rows, with their ``age``."""
        subjects = births_and_first_events(events, self.excluded)
        return subjects.withColumn("age", age_at_first_event()).where(F.col("age") >= 0)

    def rows(self, events: DataFrame, aged: DataFrame) -> DataFrame:
        raise NotImplementedError

    def apply(self, frame: EventFrame) -> EventFrame:
        # Inserted rows are untimed and never births, so source rows suffice.
        added = self.rows(frame.rows, self.aged(frame.rows))
        kept = frame if self.keep_meds_birth else frame.map(without_birth)
        return kept.insert(added, self.codes)


class EthosQuantileAge(AgeOperator):
    """Two quantile digits of the age on a scale of ``num_quantiles`` squared per century."""

    excluded = ETHOS_EXCLUDED

    def __init__(
        self,
        time_unit: str = "years",
        num_quantiles: int = 10,
        prefix: str = "AGE_",
        insert_t1_code: bool | str = True,
        insert_t2_code: bool | str = True,
        keep_meds_birth: bool | str = False,
        matching_type: str | None = None,
        matching_value: str | None = None,
    ):
        super().__init__(keep_meds_birth)
        if num_quantiles < 2:
            raise ValueError(f"{num_quantiles} age quantiles cannot tell ages apart")
        if time_unit not in SECONDS:
            raise ValueError(f"unknown age unit {time_unit!r}; known: {', '.join(SECONDS)}")
        self.time_unit = time_unit
        self.num_quantiles = num_quantiles
        self.prefix = prefix or ""
        self.with_code = {"T1": as_flag(insert_t1_code), "T2": as_flag(insert_t2_code)}
        self.codes = {
            f"{self.prefix}{digit}" if shown else NO_CODE for digit, shown in self.with_code.items()
        }

    def aged(self, events: DataFrame) -> DataFrame:
        age = F.coalesce(age_at_first_event(self.time_unit), F.lit(0.0))
        return births_and_first_events(events, self.excluded).withColumn("age", age)

    def digits(self, age: Column) -> tuple[Column, Column]:
        n = self.num_quantiles
        scaled = F.least(age * float(n**2) / 100.0, F.lit(float(n**2 - 1)))
        first = F.floor(scaled / float(n))
        second = F.rint(F.pmod(scaled, F.lit(float(n)))).cast("bigint")
        carry = second == n
        return F.when(carry, first + 1).otherwise(first), F.when(carry, F.lit(0)).otherwise(second)

    def rows(self, events: DataFrame, aged: DataFrame) -> DataFrame:
        keys = subject_keys(events)
        made = []
        for i, (digit, number) in enumerate(zip(("T1", "T2"), self.digits(F.col("age")))):
            label = F.concat(F.lit("Q"), (number + 1).cast("string"))
            name = f"{self.prefix}{digit}"
            shown = self.with_code[digit]
            made.append(
                F.struct(
                    F.lit(name if shown else NO_CODE).alias("code"),
                    (label if shown else F.concat(F.lit(f"{name}//"), label)).alias("text_value"),
                    self.inserted_seq(i).alias("seq"),
                )
            )
        exploded = aged.select(*keys, "birth.*", F.explode(F.array(*made)).alias("row"))
        return exploded.drop("time").select(*keys, *[c for c in exploded.columns if c not in (*keys, "time", "row")], "row.*")


class DecimalAge(AgeOperator):
    """Tens and ones of the age as ``AGE_decile`` and ``AGE_unit``."""

    codes = {"AGE_decile", "AGE_unit"}

    def rows(self, events: DataFrame, aged: DataFrame) -> DataFrame:
        keys = subject_keys(events)
        years = F.floor("age")
        digits = (("AGE_decile", F.floor(years / 10)), ("AGE_unit", F.pmod(years, F.lit(10))))
        made = [
            F.struct(
                F.lit(code).alias("code"),
                F.concat(F.lit("Q"), digit.cast("string")).alias("text_value"),
                self.inserted_seq(i).alias("seq"),
            )
            for i, (code, digit) in enumerate(digits)
        ]
        return aged.select(*keys, F.explode(F.array(*made)).alias("row")).select(*keys, "row.*")


class BinnedAge(AgeOperator):
    """A five-year bin as the code itself, for ages from 20 up to 100."""

    codes = {f"AGE: {low}-{low + 4}" for low in range(20, 100, 5)}

    def rows(self, events: DataFrame, aged: DataFrame) -> DataFrame:
        keys = subject_keys(events)
        low = F.floor(F.col("age") / 5) * 5
        code = F.concat(F.lit("AGE: "), low.cast("string"), F.lit("-"), (low + 4).cast("string"))
        inside = aged.where((F.col("age") >= 20) & (F.col("age") < 100))
        return inside.select(*keys, code.alias("code"), self.inserted_seq().alias("seq"))


class RawAge(AgeOperator):
    """The rounded age as the numeric value of an ``AGE`` row.

    While the value column is numeric the token reads ``45.0``; once a value
    operator has made it text, or with ``as_int_text``, it reads ``45``.
    """

    codes = {"AGE"}

    def __init__(self, keep_meds_birth: bool | str = False, decimals: int = 0, as_int_text: bool | None = None):
        super().__init__(keep_meds_birth)
        self.decimals = decimals
        self.as_int_text = as_int_text

    def apply(self, frame: EventFrame) -> EventFrame:
        if self.as_int_text:
            frame = frame.map(lambda df: df.withColumn("numeric_value", value_text(df, "numeric_value")))
        return super().apply(frame)

    def rows(self, events: DataFrame, aged: DataFrame) -> DataFrame:
        rounded = fixed_text(F.col("age"), self.decimals)
        if is_text(events, "numeric_value"):
            # Python drops trailing zeros of a rounded float but keeps one decimal.
            value = F.regexp_replace(rounded, r"(\.\d+?)0+$", "$1")
        else:
            value = rounded.cast("double")
        return aged.select(
            *subject_keys(events), F.lit("AGE").alias("code"), value.alias("numeric_value"),
            self.inserted_seq().alias("seq"),
        )
