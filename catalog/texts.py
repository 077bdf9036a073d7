"""Events as phrases and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import byte_pairs
from catalog.events import ME
from catalog.fixtures import with_views
from catalog.registry import query, stage_path
from catalog.sequences import BEFORE, mimic_gap_sql
from eventloom.operators.phrases import EventPhrases, patient_text, phrase_rows, word_timeline
from eventloom.ordering import running_total
from eventloom.sources.events import text_column

VIEWS_USED = (ME, "lookup_labitems", "lookup_icd")

VALUE_SQL = """coalesce(' ' || CASE WHEN text_value IS NOT NULL THEN
    CASE WHEN trim(text_value) = '___' THEN '' WHEN TRY_CAST(text_value AS DOUBLE) IS NOT NULL
      THEN printf('%.1f', TRY_CAST(text_value AS DOUBLE)) ELSE text_value END
    ELSE printf('%.1f', numeric_value) END, '')"""

PHRASES = {
    "valued": f"""SELECT subject_id, split, time, epoch_us(time) AS t, seq, code AS raw_code, coalesce(code, 'None') AS code,
      {VALUE_SQL} AS v, string_split(code, '//') AS p FROM {ME}""",
    "phrased": """SELECT e.*, CASE
      WHEN starts_with(e.code, 'LAB//') THEN coalesce(l.label, p[2]) || v ||
        CASE WHEN p[3] <> 'UNK' AND p[3] <> '' AND trim(v) <> '' THEN ' ' || p[3] ELSE '' END
      WHEN starts_with(e.code, 'DIAGNOSIS//ICD//') THEN coalesce(i.long_title, p[4])
      WHEN contains(e.code, 'ADMISSION') OR contains(e.code, 'DISCHARGE') OR contains(e.code, 'TRANSFER')
        THEN replace(replace(e.code, '//', ' to '), '_', ' ')
      WHEN starts_with(e.code, 'MEDICATION//') THEN CASE WHEN list_contains(p, 'START') THEN 'start ' || p[-1] ELSE p[2] || ' ' || p[-1] END
      ELSE replace(replace(e.code, '//', ' '), '_', ' ') || v END AS phrase
      FROM valued e
      LEFT JOIN lookup_labitems l ON starts_with(e.code, 'LAB//') AND TRY_CAST(p[2] AS BIGINT) = l.itemid
      LEFT JOIN lookup_icd i ON starts_with(e.code, 'DIAGNOSIS//ICD//') AND p[3] = CAST(i.icd_version AS VARCHAR) AND p[4] = i.icd_code""",
    "said": f"""SELECT *, max(t) {BEFORE} AS before_t FROM phrased WHERE code <> 'MEDS_BIRTH' AND trim(phrase) <> ''""",
    "timed": f"SELECT *, {mimic_gap_sql('(t - before_t)')} AS bucket FROM said",
    "ages": f"""SELECT subject_id, printf('%.1f', floor((epoch_us(first_event) - epoch_us(birth)) / 86400000000) / 365.25) AS age,
      epoch_us(first_event) AS first_t FROM (SELECT subject_id, min(time) FILTER (code = 'MEDS_BIRTH') AS birth,
      min(time) FILTER (code IS NULL OR code <> 'MEDS_BIRTH') AS first_event FROM {ME} GROUP BY subject_id)""",
}
ORDER = "time NULLS FIRST, seq"


def phrases(f):
    return EventPhrases(f.labitems(), f.icd(), f.icd()).translate(f.events())


@query("translate_row", with_views("SELECT subject_id, seq, phrase FROM phrased", *VIEWS_USED, **PHRASES))
def translate_row(f):
    return phrases(f).select("subject_id", "seq", "phrase")


@query("translate_value", with_views("SELECT subject_id, seq, v AS value FROM valued", *VIEWS_USED, **PHRASES))
def translate_value(f):
    events = f.events()
    return events.select("subject_id", "seq", EventPhrases("", "", "").value_part(events).alias("value"))


@query(
    "time_bucket",
    with_views(
        f"""SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY {ORDER}) AS pos, phrase, bucket FROM timed""",
        *VIEWS_USED,
        **PHRASES,
    ),
)
def time_bucket(f):
    rows = running_total(phrase_rows(phrases(f), f.events()), F.lit(1), "pos")
    return rows.df.select("subject_id", "pos", "phrase", "bucket")


def _text_sql(name: str, piece: str) -> str:
    return f"""SELECT subject_id, trim(lower(coalesce('age ' || age || '; ', '') ||
  coalesce(string_agg({piece}, '' ORDER BY {ORDER}), ''))) AS {name}
FROM ages LEFT JOIN timed USING (subject_id) GROUP BY subject_id, age"""


@query("patient_text", with_views(_text_sql("text_sequence", "phrase || '; '"), *VIEWS_USED, **PHRASES))
def patient_text_plain(f):
    return patient_text(phrases(f), f.events()).select("subject_id", "text_sequence")


@query(
    "patient_text_with_time",
    with_views(
        _text_sql("text_sequence_with_time", "coalesce(bucket || '; ', '') || phrase || '; '"), *VIEWS_USED, **PHRASES
    ),
)
def patient_text_with_time(f):
    return patient_text(phrases(f), f.events()).select("subject_id", "text_sequence_with_time")


@query(
    "translate_dataset",
    with_views(
        f"""SELECT split, count(*) AS subjects, CAST(sum(length(text_sequence)) AS BIGINT) AS characters
FROM ({_text_sql('text_sequence', "phrase || '; '")}) JOIN (SELECT DISTINCT subject_id, split FROM {ME}) USING (subject_id) GROUP BY split""",
        *VIEWS_USED,
        **PHRASES,
    ),
)
def translate_dataset(f):
    from eventloom.plans.translation import translate_dataset as translate

    path = stage_path(f, "translated")
    translate(EventPhrases(f.labitems(), f.icd(), f.icd()), f.events(), path)
    texts = f.spark.read.parquet(path)
    return texts.groupBy("split").agg(
        F.count(F.lit(1)).alias("subjects"), F.sum(F.length("text_sequence")).alias("characters")
    )


WORDS = {
    **PHRASES,
    "spoken": """SELECT subject_id, 1 AS kind, time, seq, coalesce(t, 0) AS ts_us,
        list_filter(string_split(replace(coalesce(lower(bucket) || '; ', '') || trim(lower(phrase)) || ';', chr(9), ' '), ' '), lambda w: w <> '') AS items FROM timed
      UNION ALL SELECT subject_id, 0, NULL, NULL, first_t, ['age', age || ';'] FROM ages WHERE age IS NOT NULL""",
    "words": "SELECT subject_id, kind, time, seq, ts_us, unnest(items) AS word, unnest(range(len(items))) AS part FROM spoken",
}


@query(
    "word_timeline",
    with_views(
        """SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY kind, time NULLS FIRST, seq, part) AS pos, word, ts_us
FROM words""",
        *VIEWS_USED,
        **WORDS,
    ),
)
def words(f):
    rows = running_total(word_timeline(phrases(f), f.events()), F.lit(1), "pos").df
    ts = F.round(F.col("ts") * 1e6).cast("bigint")
    return rows.select("subject_id", "pos", F.col("token").alias("word"), ts.alias("ts_us"))


# Subjects' texts with their split.
SPLIT_TEXTS = f"""SELECT subject_id, split, text_sequence_with_time FROM ({_text_sql("text_sequence_with_time", "coalesce(bucket || '; ', '') || phrase || '; '")})
  JOIN (SELECT DISTINCT subject_id, split FROM {ME}) USING (subject_id) WHERE text_sequence_with_time <> ''"""
WORD_RUNS = {
    "word_runs": f"""SELECT * EXCLUDE ws, unnest(ws) AS run, unnest(range(len(ws))) AS k
      FROM (SELECT *, {byte_pairs.byte_level('word')} AS ws FROM words)"""
}


@query(
    "meds_text_encode_timed",
    byte_pairs.checked(
        """SELECT subject_id, string_agg(array_to_string(ids, '|'), '|' ORDER BY kind, time NULLS FIRST, seq, part, k) AS tokens,
string_agg(array_to_string(list_transform(ids, lambda i: ts_us), '|'), '|' ORDER BY kind, time NULLS FIRST, seq, part, k) AS timestamps
FROM word_runs JOIN shown_runs USING (run) JOIN bp_words ON shown_runs.word = bp_words.word GROUP BY subject_id""",
        *VIEWS_USED,
        **WORDS,
        **byte_pairs.text_learning(SPLIT_TEXTS, "text_sequence_with_time", 90, WORD_RUNS),
    ),
)
def meds_text_encode_timed(f):
    from catalog.registry import joined
    from eventloom.operators.bpe import TextBpe
    from eventloom.plans.translation import encode_events_as_text

    phrased = phrases(f)
    train = patient_text(phrased.where("split = 'train'"), f.events().where("split = 'train'"))
    tokenizer = TextBpe(90).train_texts(F.col("text_sequence_with_time"), train)
    timelines = encode_events_as_text(tokenizer, phrased, f.events())
    times = F.transform("timestamps", lambda t: F.round(t * 1e6).cast("bigint").cast("string"))
    return timelines.select("subject_id", joined("tokens"), F.array_join(times, "|").alias("timestamps"))


@query(
    "drop_empty_text",
    with_views(
        "SELECT subject_id, CASE WHEN subject_id % 3 = 0 THEN '' ELSE text_sequence_with_time END AS text FROM text_rows "
        "WHERE subject_id % 3 <> 0 AND text_sequence_with_time <> ''",
        "text_rows",
    ),
)
def drop_empty_text(f):
    emptied = f.view("text_rows").withColumn(
        "text", F.when(F.pmod("subject_id", F.lit(3)) == 0, F.lit("")).otherwise(F.col("text_sequence_with_time"))
    )
    return text_column(emptied, "text", "subject_id")
