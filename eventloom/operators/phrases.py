"""Events as natural-language phrases, and the text of a subject."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.gaps import DAY, mimic_gap
from eventloom.functions.text import fixed_text, float_or_null, part, strip, title_text
from eventloom.operators.base import is_text
from eventloom.ordering import Ordered, edge_chunks, gather, in_order, last_before, order_groups, whole_groups
from eventloom.schema import BIRTH, epoch_seconds, epoch_us, subject_keys
from eventloom.session import materialize
from eventloom.sources.tables import ROW_ORDER, read_table

WITH_VALUE = ["Blood Pressure", "Weight (Lbs)", "AGE", "BMI"]
MOVES = ["ADMISSION", "DISCHARGE", "TRANSFER"]


def phrase_lookup(
    labs: DataFrame, diagnoses: DataFrame, procedures: DataFrame
) -> DataFrame:
    """``key -> name`` for lab items and both kinds of ICD codes in one table; last duplicate wins."""
    parts = [
        labs.select(F.concat(F.lit("L"), F.col("itemid").cast("string")).alias("key"), F.col("label").alias("name"), ROW_ORDER)
    ]
    for kind, table in (("D", diagnoses), ("P", procedures)):
        icd = F.concat_ws("_", F.col("icd_version").cast("string"), F.col("icd_code").cast("string"))
        parts.append(table.select(F.concat(F.lit(kind), icd).alias("key"), F.col("long_title").alias("name"), ROW_ORDER))
    lasts = [t.groupBy("key").agg(F.max_by("name", ROW_ORDER).alias("name")) for t in parts]
    return lasts[0].unionByName(lasts[1]).unionByName(lasts[2]).where("name is not null")


def one_decimal(text: Column) -> Column:
    """A number with one decimal; ``___`` becomes blank, other text stays."""
    number = float_or_null(text)
    return (
        F.when(strip(text) == "___", F.lit(""))
        .when(number.isNotNull(), fixed_text(number, 1))
        .otherwise(text)
    )


class EventPhrases:
    """Phrase per event; the lookups are CSV paths or DataFrames."""

    def __init__(self, labs: str | DataFrame, diagnoses: str | DataFrame, procedures: str | DataFrame):
        self.sources = (labs, diagnoses, procedures)
        self.lookup: DataFrame | None = None

    @classmethod
    def from_folder(cls, lookup_dir: str) -> "EventPhrases":
        """The lookup files under their usual names."""
        names = ("d_labitems.csv.gz", "d_icd_diagnoses.csv.gz", "d_icd_procedures.csv.gz")
        return cls(*(f"{lookup_dir.rstrip('/')}/{name}" for name in names))

    def load(self, events: DataFrame) -> DataFrame:
        if self.lookup is None:
            icd = {"icd_code": "string", "icd_version": "string"}
            kinds = ({"itemid": "int", "label": "string"}, icd, icd)
            tables = [read_table(events.sparkSession, s, k) for s, k in zip(self.sources, kinds)]
            self.lookup = materialize(phrase_lookup(*tables), "phrase-lookup")
        return self.lookup

    def translate(self, events: DataFrame) -> DataFrame:
        """Add ``phrase``."""
        code = F.coalesce("code", F.lit("None"))
        lab_id = F.when(part(code, 1).rlike(r"^\s*[+-]?\d+\s*$"), strip(part(code, 1)).try_cast("bigint"))
        icd = F.concat(part(code, 2), F.lit("_"), part(code, 3))
        key = (
            F.when(code.startswith("LAB//"), F.concat(F.lit("L"), lab_id.cast("string")))
            .when(code.startswith("DIAGNOSIS//ICD//"), F.concat(F.lit("D"), icd))
            .when(code.startswith("PROCEDURE//ICD//"), F.concat(F.lit("P"), icd))
        )
        # Rows without a key keep a spread one of their own.
        key = F.coalesce(key, F.concat(F.lit("\u0000"), code))
        names = self.load(events).select(F.col("key").alias("_key"), F.col("name").alias("_name"))
        keyed = events.withColumns({"_key": key, "_value": self.value_part(events), "_lab": lab_id.isNotNull()})
        joined = keyed.join(names, "_key", "left")
        return joined.withColumn("phrase", self.phrase(code)).select(*events.columns, "phrase")

    def value_part(self, events: DataFrame) -> Column:
        """Blank and the value: text first, else the number, else nothing."""
        number = F.col("numeric_value")
        if is_text(events, "numeric_value"):
            number_text = one_decimal(number)
        else:
            number_text = F.when(~F.isnan(number), fixed_text(number.cast("double"), 1))
        found = F.coalesce(one_decimal(F.col("text_value")), number_text)
        return F.coalesce(F.concat(F.lit(" "), found), F.lit(""))

    def phrase(self, code: Column) -> Column:
        value = F.col("_value")
        second, third, fourth = part(code, 1), part(code, 2), part(code, 3)
        last = F.element_at(F.split(code, "//"), -1)
        plain = F.concat(code, value)
        unit = F.when((third != "UNK") & (third != "") & (strip(value) != ""), F.concat(F.lit(" "), third))
        lab = F.concat(F.coalesce("_name", second), value, F.coalesce(unit, F.lit("")))
        icd_name = F.when(fourth.isNotNull(), F.coalesce("_name", fourth)).otherwise(plain)
        race = title_text(F.replace(F.replace(second, F.lit("RACE_"), F.lit("")), F.lit("_"), F.lit(" ")))
        spaced = F.replace(F.replace(code, F.lit("//"), F.lit(" ")), F.lit("_"), F.lit(" "))
        moved = F.replace(F.replace(code, F.lit("//"), F.lit(" to ")), F.lit("_"), F.lit(" "))
        moves = F.lit(False)
        for word in MOVES:
            moves = moves | code.contains(word)
        started = F.array_contains(F.split(code, "//"), "START")
        medication = F.when(started, F.concat(F.lit("start "), last)).otherwise(F.concat(second, F.lit(" "), last))
        return (
            F.when(code.startswith("GENDER//"), F.when(second == "F", F.lit("Female")).otherwise(F.lit("Male")))
            .when(code.startswith("RACE//"), F.concat(F.lit("Race "), race))
            .when(code.startswith("MARITAL_STATUS//"), F.upper(second))
            .when(code.startswith("LAB//"), F.when(F.col("_lab"), lab).otherwise(plain))
            .when(code.startswith("DIAGNOSIS//ICD//") | code.startswith("PROCEDURE//ICD//"), icd_name)
            .when(moves, moved)
            .when(code.startswith("MEDICATION//"), medication)
            .when(code.isin(WITH_VALUE), plain)
            .otherwise(F.concat(spaced, value))
        )


def whole_day_age(birth: Column, first_event: Column) -> Column:
    """``x.y`` years from whole days (rounded down)."""
    days = F.floor((F.unix_micros(first_event) - F.unix_micros(birth)) / DAY)
    return fixed_text(days / 365.25, 1)


def subject_ages(events: DataFrame) -> DataFrame:
    """Per subject with a birth time and a timed event: ``age`` text and the first event's time."""
    keys = subject_keys(events)
    code = F.coalesce("code", F.lit(""))
    is_birth = code == BIRTH
    found = events.groupBy(*keys).agg(
        F.min_by("time", F.when(is_birth, F.struct(epoch_us(), F.col("seq")))).alias("birth"),
        F.min(F.when(~is_birth, F.col("time"))).alias("first_event"),
    )
    return found.select(*keys, whole_day_age(F.col("birth"), F.col("first_event")).alias("age"), "first_event")


def phrase_rows(phrased: DataFrame, events: DataFrame | None = None) -> Ordered:
    """Ordered phrases without births and blanks, each with the gap to the one before."""
    code = F.coalesce("code", F.lit(""))
    df = phrased.where((code != BIRTH) & (strip(F.col("phrase")) != "")).withColumn("t_us", epoch_us())
    rows = order_groups(df, subject_keys(phrased), ["t_us", "seq"], events)
    timed = F.when(F.col("time").isNotNull(), F.col("t_us"))
    rows = last_before(rows, timed, "_before")
    gap = timed - F.col("_before")
    return rows.with_df(rows.df.withColumn("bucket", F.when(gap > 0, mimic_gap(gap))).drop("_before"))


def patient_text(phrased: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """``text_sequence`` and ``text_sequence_with_time``, one row per subject.

    ``events`` are the untranslated rows; ages read from them need no lookups.
    """
    keys = subject_keys(phrased)
    rows = phrase_rows(phrased, events)
    texts = whole_groups(rows, gather(rows, in_order(rows, "phrase", "bucket").alias("items")), "items")
    ages = subject_ages(phrased if events is None else events)
    subjects = ages.join(texts, keys, "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    age = F.when(F.col("age").isNotNull(), F.concat(F.lit("age "), "age", F.lit("; ")))

    def joined(piece) -> Column:
        pieces = F.transform(F.coalesce("items", F.array()), piece)
        return strip(F.lower(F.concat(F.coalesce(age, F.lit("")), F.array_join(pieces, ""))))

    def plain(i: Column) -> Column:
        return F.concat(i["phrase"], F.lit("; "))

    def timed(i: Column) -> Column:
        gap = F.coalesce(F.concat(i["bucket"], F.lit("; ")), F.lit(""))
        return F.concat(gap, plain(i))

    return subjects.select(
        *keys,
        "chunk",
        joined(plain).alias("text_sequence"),
        joined(timed).alias("text_sequence_with_time"),
    )


def word_timeline(phrased: DataFrame, events: DataFrame | None = None) -> Ordered:
    """Lower-case words with the time of their event; the age comes first, gaps before their event."""
    keys = subject_keys(phrased)
    rows = phrase_rows(phrased, events)
    ts = epoch_seconds()

    def words(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    bucket = F.coalesce(words(F.concat("bucket", F.lit(";"))), F.array().cast("array<string>"))
    phrase = words(F.concat(strip(F.lower("phrase")), F.lit(";")))
    spoken = rows.df.select(
        *keys, "chunk", "t_us", "seq", F.lit(1).alias("kind"), ts.alias("ts"),
        F.posexplode(F.concat(bucket, phrase)).alias("part", "token"),
    )
    age = words(F.concat(F.lit("age "), "age", F.lit(";")))
    ages = subject_ages(phrased if events is None else events).where("age is not null")
    chunk = F.lit(0)
    if rows.cut:
        ages = ages.join(edge_chunks(rows).select(*keys, "first_chunk"), keys, "left")
        chunk = F.coalesce("first_chunk", F.lit(0))
    heads = ages.select(
        *keys, chunk.alias("chunk"), F.lit(None).cast("bigint").alias("t_us"),
        F.lit(None).cast("bigint").alias("seq"), F.lit(0).alias("kind"),
        epoch_seconds("first_event").alias("ts"), F.posexplode(age).alias("part", "token"),
    )
    return replace(rows, df=heads.unionByName(spoken), order=["kind", "t_us", "seq", "part"])
