"""Sinks: zstd Parquet datasets with row counts, part files, JSONL documents, reports.

Row counts come from ``DataFrame.observe`` (collected with the write itself), not
from a second pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, rows_per_file: int | None = None, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> int:
    """zstd Parquet; ``rows_per_file`` caps rows per part file (the reference writes
    50,000-row parts). Returns the number of rows written."""
    obs = Observation("write_rows")
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = counted.write.mode(mode).option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(obs.get.get("rows", 0))


def write_jsonl(df: DataFrame, path: str, column: str | None = None, mode: str = "overwrite") -> int:
    """One JSON document per line. With ``column`` the (already JSON) text column is
    written as is; otherwise each row is serialized with ``write.json``."""
    obs = Observation("jsonl_rows")
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if column:
        counted.select(F.col(column).alias("value")).write.mode(mode).text(path)
    else:
        counted.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return int(obs.get.get("rows", 0))


def append_traces(traces: DataFrame, path: str) -> int:
    """Append trace rows with a UTC ``timestamp`` when missing (JSON lines)."""
    if "timestamp" not in traces.columns:
        traces = traces.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return write_jsonl(traces, path, mode="append")


def write_reports(reports: dict[str, DataFrame], base: str) -> dict[str, int]:
    """A report set: one JSON directory per named report frame (long format)."""
    return {name: write_jsonl(df, f"{base.rstrip('/')}/{name}") for name, df in reports.items()}
