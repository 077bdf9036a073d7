"""Intermediate tables go with the application that made them."""

import os
import subprocess
import sys
import textwrap
import time

from eventloom.operators.filters import TopKCodes

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scratch_tables_are_removed_at_the_end(tmp_path):
    script = textwrap.dedent(
        f"""
        import os
        from pyspark.sql import SparkSession
        from eventloom.session import materialize
        builder = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
        spark = builder.config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
        assert materialize(spark.range(3), "numbers").count() == 3
        (folder,) = [f for f in os.listdir("{tmp_path}") if f.startswith("eventloom-")]
        assert len(os.listdir("{tmp_path}/" + folder)) == 1
        spark.range(2).write.parquet("{tmp_path}/kept")
        """
    )
    subprocess.run([sys.executable, "-c", script], check=True, env={**os.environ, "PYTHONPATH": REPO}, timeout=300)
    scratch = lambda: [f for f in os.listdir(tmp_path) if f.startswith("eventloom-")]
    until = time.time() + 30  # the JVM ends after its driver
    while scratch() and time.time() < until:
        time.sleep(0.5)
    assert not scratch() and os.path.exists(tmp_path / "kept")


def test_top_codes_by_list_and_by_join(spark, fixtures, monkeypatch):
    events = fixtures.events()
    operator = TopKCodes("starts_with", "LAB//", k=4).fit(events)
    rows = lambda: sorted(map(str, operator.transform(events).select("subject_id", "seq", "code").collect()))
    listed = rows()
    monkeypatch.setattr(TopKCodes, "IN_LIST_LIMIT", 0)
    assert rows() == listed and len(listed) < events.count()
