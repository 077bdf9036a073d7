"""Event-shaped views over the driver's tables.

The statements run unchanged in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.schema import event_table
from eventloom.session import prepare, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

VIEWS = {
    "meds_events": """
SELECT subject_id, time, code, numeric_value, text_value, unit, seq,
  CASE WHEN subject_id % 10 < 7 THEN 'train' WHEN subject_id % 10 < 9 THEN 'tuning' ELSE 'held_out' END AS split
FROM (
  SELECT user_id AS subject_id, CAST(ts AS TIMESTAMP) AS time,
    CASE WHEN k = 99 THEN NULL
         WHEN event_type = 'purchase' THEN concat('LAB//', CAST(k % 10 AS STRING), '//mg/dL')
         WHEN event_type = 'error' THEN concat('LAB//', CAST(900 + k % 4 AS STRING), '//UNK')
         WHEN event_type = 'click' THEN concat('DIAGNOSIS//ICD//10//E', CAST(k AS STRING))
         WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'MEDICAL//bmi' ELSE 'BMI (kg/m2)' END
         WHEN k % 2 = 0 THEN concat('MEDICATION//START//drug', CAST(k % 5 AS STRING))
         ELSE concat('HOSPITAL_ADMISSION//WARD_', CAST(k % 3 AS STRING)) END AS code,
    CASE WHEN event_type IN ('purchase', 'error') AND k <> 50 THEN value
         WHEN event_type = 'view' AND k % 2 = 0 THEN value END AS numeric_value,
    CASE WHEN event_type = 'view' AND k % 2 = 1 THEN CASE WHEN k % 7 = 0 THEN '___' ELSE CAST(k AS STRING) END END AS text_value,
    CAST(NULL AS STRING) AS unit,
    event_id AS seq
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
  UNION ALL
  SELECT user_id, CAST(DATE '1930-01-01' + CAST((user_id % 400) * 80 AS INT) AS TIMESTAMP),
    'MEDS_BIRTH', CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(-1 AS BIGINT)
  FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 13 <> 0
) t""",
    # Every eleventh subject has no row on purpose: the operators must cope with it.
    "static_subjects": """
SELECT c_custkey AS subject_id, CAST(1 AS INT) AS file_order,
  CASE WHEN c_custkey % 4 = 0 THEN 'male' WHEN c_custkey % 4 = 1 THEN ' Female ' WHEN c_custkey % 4 = 2 THEN 'OTHER/UNKNOWN' END AS gender,
  c_mktsegment AS marital_status, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey % 11 <> 0
UNION ALL
SELECT c_custkey, CAST(2 AS INT), 'female', c_mktsegment, 'SECOND_ROW' FROM customer WHERE c_custkey % 9 = 0""",
    "lookup_labitems": """
SELECT p_partkey AS itemid, p_name AS label, p_type AS category FROM part""",
    "lookup_icd": """
SELECT concat('E', CAST(s_suppkey AS STRING)) AS icd_code, CAST(10 AS INT) AS icd_version, s_name AS long_title FROM supplier
UNION ALL
SELECT concat('E', CAST(s_suppkey AS STRING)), CAST(9 AS INT), concat('old ', s_name) FROM supplier""",
    "subject_labels": """
SELECT doc_id AS subject_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS is_case,
  CASE WHEN quality = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'lung' WHEN 1 THEN 'pancreas' ELSE 'upgi' END END AS site,
  CASE WHEN quality = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'bad date' ELSE concat('2024-02-0', CAST(1 + doc_id % 9 AS STRING)) END END AS cancerdate
FROM labels""",
    "text_rows": """
SELECT doc_id AS subject_id, text AS text_sequence_with_time, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents""",
    "subject_notes": """
SELECT conv_id AS subject_id, concat('2024-01-10 ', CASE WHEN turn < 10 THEN '0' ELSE '' END, CAST(turn % 24 AS STRING), ':00:00') AS charttime, text FROM conversations""",
    # Terms for two-part codes, with a duplicate key that differs only in case.
    "medical_terms": """
SELECT concat('E', CAST(s_suppkey AS STRING)) AS code, s_name AS term, CAST(1 AS INT) AS file_order FROM supplier
UNION ALL SELECT 'bmi', 'Body mass index', CAST(1 AS INT)
UNION ALL SELECT 'BMI', 'Body Mass', CAST(2 AS INT)""",
    "lab_terms": """
SELECT CAST(p_partkey AS STRING) AS code, p_name AS term, CAST(1 AS INT) AS file_order FROM part""",
    "region_terms": """
SELECT r_regionkey AS regionid, r_name AS "Description" FROM region""",
}


class Fixtures:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in ("events", "documents") else df

    def view(self, name: str) -> DataFrame:
        statement = VIEWS[name].replace('"Description"', "Description")
        used = [t for t in TABLES if t in statement]
        for table in used:
            self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(statement)

    def events(self) -> DataFrame:
        return event_table(self.view("meds_events"))

    def static(self) -> DataFrame:
        return self.view("static_subjects")

    def labitems(self) -> DataFrame:
        return self.view("lookup_labitems")

    def icd(self) -> DataFrame:
        return self.view("lookup_icd").withColumn("file_order", F.lit(1))


def with_views(body: str, *names: str, **ctes: str) -> str:
    """A DuckDB statement: fixture views and further CTEs before ``body``."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in names]
    parts += [f"{name} AS ({text.strip()})" for name, text in ctes.items()]
    return f"WITH {', '.join(parts)}\n{body.strip()}"
