import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from eventloom.session import prepare

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def fixtures(spark):
    from catalog.fixtures import Fixtures

    return Fixtures(spark, SF)


@pytest.fixture
def small_groups(spark):
    """Treat every subject with more than 20 rows as too large for one task."""
    from eventloom.ordering import LIMIT_KEY

    spark.conf.set(LIMIT_KEY, "20")
    yield
    spark.conf.unset(LIMIT_KEY)


@pytest.fixture
def make_events(spark):
    from eventloom.schema import event_table

    def make(rows):
        """Rows of (subject, ISO time or None, code, number, text)."""
        schema = "subject_id bigint, at string, code string, numeric_value double, text_value string, seq bigint"
        numbered = [(*row, i) for i, row in enumerate(rows)]
        df = spark.createDataFrame(numbered, schema)
        return event_table(df.withColumn("time", df.at.cast("timestamp")).drop("at"))

    return make
