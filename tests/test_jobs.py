"""Batch jobs end to end (files in the shared checkpoint folder) and streaming = batch."""

import uuid

from pyspark.sql import functions as F

from scanmart.operators import marts as M
from scanmart.plans import catalog as CAT
from scanmart.plans import pipeline as PL
from scanmart.session import shared_path
from scanmart.sources import suffixes as PSL
from scanmart.streaming import jobs as ST
from tests.conftest import SF


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_batch_pipeline_matches_adapter(spark):
    run = shared_path(spark, f"test-pipeline-{uuid.uuid4().hex}")
    CAT.raw_lines(spark, SF).orderBy("sequence").select("value").coalesce(1).write.text(f"{run}/raw")
    n = PL.build_observations(spark, f"{run}/raw", f"{run}/obs", rows_per_file=300, extra_rules=PSL.FIXTURE_RULES)
    assert n == CAT.observations(spark, SF).count()
    v = PL.validate(spark, f"{run}/obs").first()
    assert v.valid and v.row_count == n and v.part_count >= 2 and v.missing_required_columns == []
    counts = PL.build_marts(spark, f"{run}/obs", f"{run}/marts")
    PL.build_signals_and_scores(spark, f"{run}/marts")
    cols = ["domain", "observation_count", "unique_ip_count", "unique_port_count", "critical_vulnerability_observations",
            "exposed_database_count", "eol_observation_count", "technologies"]
    assert _rows(spark.read.parquet(f"{run}/marts/accounts"), cols) == _rows(CAT.accounts(spark, SF), cols)
    assert counts["accounts"] == CAT.accounts(spark, SF).count()
    written = PL.build_context(spark, f"{run}/marts", f"{run}/obs", f"{run}/context", limit=10)
    assert written == 10
    docs = spark.read.json(f"{run}/context")
    assert docs.count() == 10 and {"account", "metrics", "scores", "signals", "evidence"} <= set(docs.columns)


def test_stream_ingest_equals_batch_and_refresh(spark):
    run = shared_path(spark, f"test-stream-{uuid.uuid4().hex}")
    CAT.raw_lines(spark, SF).select("value").write.text(f"{run}/src")
    q = ST.ingest(spark, f"{run}/src", f"{run}/obs", f"{run}/ckpt", max_files=1, extra_rules=PSL.FIXTURE_RULES)
    q.awaitTermination()
    # starting again on the same files adds nothing
    q = ST.ingest(spark, f"{run}/src", f"{run}/obs", f"{run}/ckpt", extra_rules=PSL.FIXTURE_RULES)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{run}/obs")
    batch = CAT.q_records_observations(spark, SF)
    cols = [c for c in CAT.RECORD_CHECK_COLUMNS if c != "observation_id"]
    assert _rows(streamed, cols) == _rows(batch, cols)
    # incremental account refresh over the curated stream output
    # a few files per micro-batch, so later batches merge into the state of earlier ones
    src = spark.readStream.schema(streamed.schema).option("maxFilesPerTrigger", 2).parquet(f"{run}/obs")
    r = ST.refresh_accounts(spark, f"{run}/accounts", f"{run}/ckpt-acc", src)
    r.awaitTermination()
    assert spark.read.parquet(f"{run}/accounts/log").where("version >= 0").select("version").distinct().count() > 1
    latest = ST.latest_accounts(spark, f"{run}/accounts")
    want = M.accounts_mart(streamed)
    assert latest.columns == want.columns and sorted(map(repr, latest.collect())) == sorted(map(repr, want.collect()))


def test_reports(spark):
    lines = CAT.raw_lines(spark, SF).select(F.lit("t").alias("file"), F.col("value").alias("line"))
    rep = PL.nested_report(lines, sample_size=200)
    assert rep["totals"].first().sample_size == 200
    assert rep["vulns"].count() == 1
    srep = PL.schema_report(lines)
    assert srep["lines"].first().invalid_lines == 0
    prof = PL.profile_report(CAT.raw_variant(spark, SF))
    assert prof["field_presence"].count() == 14
