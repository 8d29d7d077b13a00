"""Queries on the smallest tables with ids as large as those of large tables."""

from pyspark.sql import functions as F

from agentmeter import fixtures as fx
from agentmeter.plans import QUERIES


def test_late_rows_of_large_ids_are_all_there(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(400)
    events.withColumn("event_id", F.col("event_id") + 5_000_000_000).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["o_x7_late_rows"](spark, str(tmp_path)).agg(F.sum("n")).first()[0]
    assert got == fx.requests(spark, str(tmp_path)).count()
