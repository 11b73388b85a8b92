"""Sessions as a caller has them: without settings of ours, or on a large cluster."""

import os
import subprocess
import sys

from siftwarden.sources import tables

BARE = """
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert __spark_entry__.entry(spark).count() > 0
assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
"""


def test_entry_on_a_session_without_settings(data):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "TZ": "America/New_York"}
    subprocess.run([sys.executable, "-c", BARE], cwd=root, env=env, check=True, capture_output=True, timeout=300)


def test_only_small_scans_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    df = spark.read.parquet(f"{tmp_path}/one.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" in plan(tables.spread_out(df))
    assert "Exchange" not in plan(tables.spread_out(df, size - 1))
    assert tables.spread_out(df).count() == 1000


def test_a_stage_that_was_cleared_away_is_made_again(spark, data):
    from siftwarden.plans import records

    before = records.QUERIES["p3_tokens"](spark, data).count()
    stage = records._STAGES[(spark.sparkContext.applicationId, data)]
    for f in stage.inputFiles():
        os.remove(f.removeprefix("file://"))
    assert not tables.still_there(stage)
    assert records.QUERIES["p3_tokens"](spark, data).count() == before > 0
