"""Rows of a table in tasks of a bounded number, and records parsed only above the exchange that spreads them."""

import uuid

from pyspark.sql import functions as F

from scanmart.operators import profiling as P
from scanmart.plans import lines as L
from scanmart.session import shared_path
from scanmart.sources import ndjson as N
from tests.conftest import SF


def per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_one_row_group_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS_PER_TASK", 500)
    path = shared_path(spark, f"test-dealt-{uuid.uuid4().hex}")
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.lit("same").alias("t"))  # nulls and copies
    rows.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # many splits, of which one has the rows
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > 16 and max(per_task(scan)) == 20_000
        dealt = N.dealt(scan)
        assert dealt.rdd.getNumPartitions() == 40 and max(per_task(dealt)) < 750
        assert dealt.columns == scan.columns and dealt.exceptAll(scan).isEmpty() and scan.exceptAll(dealt).isEmpty()
        assert N.dealt(scan.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_lines_are_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS_PER_TASK", 50)
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    for lines in (L.record_lines(spark, SF), L.rich_lines(spark, SF)):
        found = per_task(lines)
        assert sum(found) == events and max(found) <= 100


def test_organisations_are_parsed_above_the_exchange(spark):
    records = L.record_lines(spark, SF).select("sequence", F.parse_json("value").alias("v"))
    plan = P.org_aliases(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "parseJson" not in plan[plan.index("Repartition"):]
