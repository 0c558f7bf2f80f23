"""Tables in hash buckets of which a change rewrites the touched ones only.

    <base>/rows/version=<n>/bucket=<k>/...   what version n made of bucket k
    <base>/log/version=<n>                   the buckets that version n made, and whether they have rows

A bucket's rows are those of its newest version. A version is written before its log entry, and
writing a version again (a batch that is run again after a failure) overwrites it; it must read
with ``before`` set to its own number. Only numbers of buckets reach the driver, and their count
is a parameter that must stay the same for a table. Versions that newer ones have replaced are
left to the owner of the folder to clear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


_LOG = "bucket int, filled boolean"


def start(spark: SparkSession, base: str) -> None:
    """Makes the log, if there is none; a table that is there stays as it is."""
    spark.createDataFrame([], _LOG).write.mode("overwrite").parquet(f"{base}/log/version=-1")


def touched(rows: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """The buckets of ``rows``: at most ``buckets`` numbers."""
    return [r["bucket"] for r in rows.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()]


def newest(spark: SparkSession, base: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> its newest version (older than ``before``), for the buckets that have rows in it."""
    log = spark.read.schema(f"{_LOG}, version bigint").option("basePath", f"{base}/log").parquet(f"{base}/log")
    log = log if before is None else log.where(F.col("version") < before)
    last = log.where("bucket is not null").groupBy("bucket").agg(F.max(F.struct("version", "filled")).alias("last"))
    return {r["bucket"]: r["version"] for r in last.where("last.filled").select("bucket", "last.version").collect()}


def read(spark: SparkSession, base: str, schema, buckets: list[int] | None = None, before: int | None = None,
         rows: str = "rows") -> DataFrame:
    """The rows of these buckets (None: of all); no other bucket is listed or read."""
    found = {k: v for k, v in newest(spark, base, before).items() if buckets is None or k in buckets}
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{base}/{rows}/version={v}/bucket={k}" for k, v in sorted(found.items())))


def write(df: DataFrame, base: str, key: str, version: int, buckets: int = BUCKETS, rows: str = "rows") -> DataFrame:
    """``df`` as a version of its buckets, read back (a bucket that is too large for a task is written by several: AQE splits it)."""
    path = f"{base}/{rows}/version={version}"
    df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    schema = df.withColumn("bucket", F.lit(0)).schema
    return df.sparkSession.read.schema(schema).parquet(path)


def commit(written: DataFrame, base: str, made: list[int], version: int) -> None:
    """Enters a version (as :func:`write` gave it) in the log; ``made`` are its buckets, with rows or without."""
    spark = written.sparkSession
    filled = written.select("bucket", F.lit(True).alias("filled")).distinct()
    log = spark.createDataFrame([(k,) for k in made], "bucket int").join(filled, "bucket", "left")
    log.select("bucket", F.coalesce("filled", F.lit(False)).alias("filled")).coalesce(1).write.mode("overwrite").parquet(f"{base}/log/version={version}")
