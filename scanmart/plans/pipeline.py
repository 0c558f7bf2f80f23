"""End-to-end batch jobs (the reference's command-line steps, as Spark jobs).

    NDJSON(.zst) -> curated observations (Parquet parts)
    observations -> accounts / account_services marts -> signals / scored accounts
    scored + signals + observations -> account context JSONL
    raw records -> profiling report set;  curated dataset -> validation row

Intermediate tables are written to the given paths; a job that reads them again
starts from the written table (lineage cut), so a lost executor only recomputes the
current stage.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scanmart.operators import context as CX
from scanmart.operators import marts as M
from scanmart.operators import profiling as P
from scanmart.operators import records as R
from scanmart.operators import reports as RP
from scanmart.operators import scoring as SC
from scanmart.operators import signals as S
from scanmart.sources import ndjson as N
from scanmart.sources import sinks


def build_observations(spark: SparkSession, source: str, output: str, rows_per_file: int = 50_000,
                       partitions: int | None = None, strict: bool = True, extra_rules=()) -> int:
    """Records -> 64-column observations; ``sequence`` numbers object records in scan
    order (per-partition offsets, no single-task numbering)."""
    records = N.read_numbered_records(spark, source, strict=strict, partitions=partitions)
    obs = R.records_to_observations(records, extra_rules)
    return sinks.write_parquet(obs, output, rows_per_file=rows_per_file)


def build_with_quarantine(spark: SparkSession, source: str, output: str, rows_per_file: int = 50_000,
                          partitions: int | None = None, extra_rules=()) -> dict[str, int]:
    """Records -> observations, and lines that hold none -> quarantine, in one write and one parse of each line.

    Both are folders of one table (``kind=observations`` and ``kind=quarantine``); the numbers of
    either are observed by the write. ``sequence`` numbers all non-blank lines in file order, so a
    record's number is that of the strict build where no line is invalid."""
    lines = N.numbered_lines(spark, source)
    rows = N.with_reason(N.spread(lines, partitions, probe=spark.read.text(source)))
    kept = rows.withColumn("line_file", F.when(F.col("reason").isNotNull(), F.col("file"))).withColumn(
        "line", F.when(F.col("reason").isNotNull(), F.col("line"))).withColumnRenamed("sequence", "line_number")
    out = R.records_to_observations(kept, extra_rules, seq_col="line_number", keep=("line_file", "line_number", "line", "reason"))
    seen = Observation("ingest")
    out = out.observe(seen, F.count_if(F.col("reason").isNull()).alias("records"), F.count("reason").alias("invalid_lines"))
    out = out.withColumn("kind", F.when(F.col("reason").isNull(), "observations").otherwise("quarantine"))
    out.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("kind").parquet(output)
    return {k: int(v) for k, v in seen.get.items()}


def built_observations(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).where("kind = 'observations'").select(*R.OBSERVATION_COLUMNS)


def quarantined(spark: SparkSession, output: str) -> DataFrame:
    """(file, line_number, line, reason) of the lines that hold no record."""
    return spark.read.parquet(output).where("kind = 'quarantine'").select(F.col("line_file").alias("file"), "line_number", "line", "reason")


def build_marts(spark: SparkSession, observations: str, output: str) -> dict[str, int]:
    obs = spark.read.parquet(observations)
    return {
        "accounts": sinks.write_parquet(M.accounts_mart(obs), f"{output}/accounts"),
        "account_services": sinks.write_parquet(M.services_mart(obs), f"{output}/account_services"),
    }


def build_signals_and_scores(spark: SparkSession, marts: str) -> dict[str, int]:
    accounts = spark.read.parquet(f"{marts}/accounts")
    return {
        "account_signals": sinks.write_parquet(S.account_signals(accounts), f"{marts}/account_signals"),
        "scored_accounts": sinks.write_parquet(SC.scored_accounts(accounts), f"{marts}/scored_accounts"),
    }


def build_context(spark: SparkSession, marts: str, observations: str, output: str, limit: int = 1000,
                  evidence_per_account: int = 5) -> int:
    if limit <= 0 or evidence_per_account <= 0:
        raise ValueError("limit and evidence_per_account must be greater than zero")
    scored = spark.read.parquet(f"{marts}/scored_accounts")
    signals = spark.read.parquet(f"{marts}/account_signals")
    obs = spark.read.parquet(observations)
    top = CX.top_accounts(scored, limit)
    ctx = CX.account_context(top, signals, CX.account_evidence(obs, top, evidence_per_account))
    return sinks.write_jsonl(CX.context_json(ctx), output, column="context")


def profile_report(records: DataFrame, top_values: int = 10) -> dict[str, DataFrame]:
    """Field profile report (presence, types, top values, organisation aliases), one pass over the records."""
    return RP.profile_report(records, top_values)


def nested_report(lines: DataFrame, sample_size: int = 8000, seed: int = 42) -> dict[str, DataFrame]:
    """Nested-field report over a deterministic sample of lines (exact size), one pass over the sample."""
    records = N.parse_records(P.sample_fixed(lines, sample_size, seed), strict=False)
    return RP.nested_report(records, order="file") | {
        "totals": lines.agg(F.count(F.lit(1)).alias("total_records_streamed")).withColumn("sample_size", F.lit(sample_size))}


def schema_report(lines: DataFrame) -> dict[str, DataFrame]:
    """Schema discovery over every record, the invalid-line count and the first records."""
    records = N.parse_records(lines, strict=False)
    return RP.schema_report(lines) | {"samples": P.first_samples(records, 3, order="file")}


def throughput(spark: SparkSession, path: str) -> dict:
    """Object records of an NDJSON source and how many were read and parsed a second."""
    began = time.perf_counter()
    records = N.read_records(spark, path, strict=False).select(F.schema_of_variant("v").alias("s")).agg(
        F.count("s")).first()[0]
    elapsed = time.perf_counter() - began
    return {"records": records, "elapsed_seconds": round(elapsed, 3), "records_per_second": round(records / elapsed, 1)}


def validate(spark: SparkSession, path: str) -> DataFrame:
    return P.quality_check(spark.read.parquet(path), count_parts=True)
