"""Streaming jobs. Checkpoints live under the shared ``spark.checkpoint.dir`` so a
restarted driver or lost executors resume from the last committed batch.

A micro-batch may be run again after a failure. What it writes goes into folders that carry its
stream and batch, which a second run overwrites, and what it reads of the state is what other
batches have written, so that the second run gives the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from scanmart.operators import marts as M
from scanmart.operators import records as R
from scanmart.sources import buckets
from scanmart.sources import ndjson as N


def stream_name(checkpoint: str) -> str:
    """The name under which a stream writes: that of its checkpoint folder, hashed."""
    return "s" + hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def stream_lines(spark: SparkSession, source_dir: str, max_files: int = 100) -> DataFrame:
    """NDJSON(.zst) directory as a stream of (file, split, line), blank lines removed."""
    return N.text_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(source_dir))


def file_identities(tagged: DataFrame) -> DataFrame:
    """(file, content, lines, splits) of the lines (file, split, line, _at) of a scan, one row per file.

    content is a hash of the file's lines whatever their order: their number and the sums of two
    of their hashes, which are added up before the shuffle. splits: (split, n, first), the lines
    of each split and the least ``_at``."""
    wide = "decimal(38,0)"
    parts = tagged.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.sum(F.xxhash64("line").cast(wide)).alias("a"),
        F.sum(F.conv(F.substring(F.sha1("line"), 1, 15), 16, 10).cast(wide)).alias("b"))
    files = parts.groupBy("file").agg(
        F.sum("n").alias("lines"), F.sum("a").alias("a"), F.sum("b").alias("b"),
        F.array_sort(F.collect_list(F.struct("split", "n", "first"))).alias("splits"))
    return files.select("file", F.sha1(F.concat_ws(":", *(F.col(c).cast("string") for c in ("lines", "a", "b")))).alias("content"), "lines", "splits")


def numbered_of_files(tagged: DataFrame, files: DataFrame) -> DataFrame:
    """(line, sequence) for the lines of the files in ``files``: the file's content and the line's number in the file."""
    parts = files.select("file", "content", F.explode("splits").alias("s")).select("file", "content", "s.*")
    before = F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    rows = tagged.join(parts, ["file", "split"])
    at = F.col("_at") - F.col("first")
    lost = F.raise_error(F.concat(F.lit("a line of "), F.col("file"), F.lit(" is outside its split")))
    number = F.when((at < 0) | (at > 1 << 33), lost).otherwise(F.col("before") + at)
    return rows.select("line", F.concat_ws(":", "content", number.cast("string")).alias("sequence"))


def ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, max_files: int = 100,
           extra_rules=(), files_dir: str | None = None) -> StreamingQuery:
    """J1 (+J4): records -> curated observations in Parquet; malformed and non-object lines are
    dropped (tolerant).

    Files are known by their content. The contents that have been taken in are kept as a table
    of one row a file (``files_dir``); a file whose content is in it, or in an earlier file of the
    same micro-batch, is a replay under whatever name and adds nothing, whenever it comes. Equal
    lines of files that differ anywhere are all kept, as in the batch job. What a micro-batch
    reads besides its own files is that table, never the sink. Lines are numbered within their
    file on the unshuffled scan, so text is not moved."""
    files_dir, stream = files_dir or f"{sink_dir.rstrip('/')}-files", stream_name(checkpoint)
    schema = "file string, content string, lines bigint, splits array<struct<split:bigint,n:bigint,first:bigint>>, stream string, batch bigint"

    def curated(numbered: DataFrame) -> DataFrame:
        return R.records_to_observations(N.parse_records(numbered, strict=False), extra_rules)

    none = spark.createDataFrame([], "line string, sequence string")
    curated(none).write.mode("overwrite").parquet(f"{sink_dir}/stream={stream}/batch=-1")
    spark.createDataFrame([], schema).drop("stream", "batch").write.mode("overwrite").parquet(f"{files_dir}/stream={stream}/batch=-1")

    def append(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("_at", F.monotonically_increasing_id())
        known = spark.read.schema(schema).option("basePath", files_dir).parquet(files_dir).where(
            (F.col("stream") != stream) | (F.col("batch") != batch_id)).select("content")
        first = file_identities(tagged).withColumn("copy", F.row_number().over(W.partitionBy("content").orderBy("file"))).where("copy = 1").drop("copy")
        own = f"{files_dir}/stream={stream}/batch={batch_id}"
        first.join(known, "content", "left_anti").select("file", "content", "lines", "splits").write.mode("overwrite").parquet(own)
        numbered = numbered_of_files(tagged, spark.read.schema(first.schema).parquet(own))
        curated(numbered).write.mode("overwrite").parquet(f"{sink_dir}/stream={stream}/batch={batch_id}")

    return (stream_lines(spark, source_dir, max_files).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def rolling_cost_stream(traces: DataFrame, threshold: float = 2.0) -> DataFrame:
    """J2: 24 h sliding windows (1 h slide) of spend per workflow, 1 h watermark."""
    return (traces.withWatermark("timestamp", "1 hour")
            .groupBy(F.window("timestamp", "24 hours", "1 hour"), "workflow")
            .agg(F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")).alias("_c"), F.count(F.lit(1)).alias("calls"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "workflow", (F.col("_c") / 1e6).alias("cost_usd"), "calls")
            .withColumn("alert", F.col("cost_usd") > threshold))


def upsert_batches(df: DataFrame, sink_dir: str, checkpoint: str) -> StreamingQuery:
    """Update-mode sink: every micro-batch appends its changed rows tagged with the
    batch id; readers take the latest version per key (:func:`latest_versions`)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_dir)
    return (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in versions.columns if c not in keys and c != "batch_id"]
    return (versions.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_s"))
            .select(*keys, "_s.*"))


def latest_accounts(spark: SparkSession, accounts_dir: str) -> DataFrame:
    """The accounts as :func:`refresh_accounts` left them: of each bucket the newest version, whose files alone are read."""
    schema = M.accounts_of(spark.createDataFrame([], M.FACT_SCHEMA)).schema
    return buckets.read(spark, accounts_dir, schema, rows="accounts")


def refresh_accounts(spark: SparkSession, accounts_dir: str, checkpoint: str, source: DataFrame,
                     count: int = buckets.BUCKETS) -> StreamingQuery:
    """J3: accounts kept up to date from a stream of new observations.

    The state is the account mart's first level (domain, kind, value, counts), whose rows can be
    merged, so distinct counts stay exact without the observations seen before. It is dealt
    into ``count`` buckets by a hash of the domain (:mod:`scanmart.sources.buckets`). A
    micro-batch folds its own observations, reads the state of the buckets that they touch, and
    writes these buckets and their accounts as a new version; other buckets are neither read nor
    written, and the curated table is not read at all."""
    facts_type = spark.createDataFrame([], M.FACT_SCHEMA).schema
    buckets.start(spark, accounts_dir)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        delta = f"{accounts_dir}/delta"
        M.account_facts(batch).write.mode("overwrite").parquet(delta)
        facts = spark.read.schema(facts_type).parquet(delta)
        made = buckets.touched(facts, "domain", count)
        old = buckets.read(spark, accounts_dir, facts_type, made, batch_id)
        state = buckets.write(M.merged_facts(old.unionByName(facts)), accounts_dir, "domain", batch_id, count)
        buckets.write(M.accounts_of(state.drop("bucket")), accounts_dir, "domain", batch_id, count, rows="accounts")
        buckets.commit(state, accounts_dir, made, batch_id)

    return (source.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
