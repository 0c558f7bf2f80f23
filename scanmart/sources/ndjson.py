"""Newline-delimited JSON records (plain or ``.zst``) as a VARIANT column.

The codec is chosen from the file extension by Hadoop; ``.zst`` decodes natively.
A single ``.zst`` file is not splittable (one task), so callers should repartition
right after the scan, before parsing, when reading one large file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of a zstd frame, in hexadecimal.
ZSTD_MAGIC = "28B52FFD"


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Of equal keys of a JSON object the last counts (instead of failing the job)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def spread(df: DataFrame, partitions: int | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Round-robin repartition when the input has fewer partitions than the cluster has
    cores (one unsplittable ``.zst`` file, or one small file with heavy per-row parsing);
    inputs that are already split are left alone (no extra shuffle).

    ``probe`` is the plain file scan the input comes from: its split count is known
    from the file listing alone, while asking a plan with exchanges for its partition
    count would make adaptive execution run those stages first."""
    target = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if (probe if probe is not None else df).rdd.getNumPartitions() < target else df


#: Rows of a table that one task makes record lines of and parses (about 0.1 ms each).
ROWS_PER_TASK = 100_000


def tasks_for(scan: DataFrame) -> int:
    """Tasks for the rows of a file scan: one for each ``ROWS_PER_TASK`` of them, and at least one for each core.

    Parquet files tell their row counts in their footers: no column is read."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS_PER_TASK))


def dealt(scan: DataFrame) -> DataFrame:
    """The rows of a Parquet scan dealt out evenly over :func:`tasks_for` of them.

    The splits of a Parquet file say nothing of the rows in a task: all rows of a row group go to one of them. Rows
    are dealt by their place in the scan, so no value is hot, nothing is sorted and a task that is run again
    sends the same rows to the same places."""
    placed = scan.withColumn("_at", F.monotonically_increasing_id())
    return placed.repartition(tasks_for(scan), "_at").drop("_at")


def read_lines(spark: SparkSession, path: str, partitions: int | None = None, spread_out: bool = True) -> DataFrame:
    """Text lines with the source file name; blank lines removed; spread over the
    cluster before parsing when the scan yields too few partitions (``spread_out``).

    A zstd file without the ``.zst`` extension would be read as garbage text: its first
    line fails the job, whatever store it is in."""
    df = text_lines(spark.read.text(path)).drop("split")
    return spread(df, partitions) if spread_out else df


def text_lines(df: DataFrame) -> DataFrame:
    """(file, split, line) of a text scan without its blank lines."""
    packed = F.hex(F.substring(F.col("value").cast("binary"), 1, 4)) == ZSTD_MAGIC
    df = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.when(
        packed, F.raise_error(F.concat(F.col("_metadata.file_path"), F.lit(" is zstd-compressed but lacks the .zst extension"))))
        .otherwise(F.col("value")).alias("line"))
    return df.filter(F.col("line").rlike(r"\S"))


def parse_records(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines -> ``v`` VARIANT of object records only.

    strict: malformed JSON fails the job (``parse_json``), non-object values are skipped.
    tolerant: ``try_parse_json``; malformed and non-object lines are dropped.
    """
    allow_duplicate_keys(lines.sparkSession)
    v = F.parse_json("line") if strict else F.try_parse_json("line")
    df = lines.withColumn("v", v)
    return df.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")).drop("line")


def line_quality(lines: DataFrame) -> DataFrame:
    """Tolerant accounting: total non-blank lines, object records and invalid lines."""
    allow_duplicate_keys(lines.sparkSession)
    v = F.try_parse_json("line")
    is_obj = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    return lines.agg(F.count(F.lit(1)).alias("lines"),
                     F.count_if(is_obj).alias("records"),
                     F.count_if(~is_obj | v.isNull()).alias("invalid_lines"))


def read_records(spark: SparkSession, path: str, strict: bool = True, partitions: int | None = None) -> DataFrame:
    return parse_records(read_lines(spark, path, partitions), strict)


def object_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """The lines that hold an object. Strict: the first character tells (a malformed line
    fails when it is parsed); tolerant: the line must parse."""
    opens = F.col("line").rlike(r"^\s*\{")
    if strict:
        return lines.filter(opens)
    allow_duplicate_keys(lines.sparkSession)
    return lines.filter(opens & F.try_parse_json("line").isNotNull())


#: Splits up to which their counts (24 bytes each) are broadcast.
BROADCAST_SPLITS = 1 << 20


def with_sequence(scan: DataFrame, name: str = "sequence") -> DataFrame:
    """Running 0-based number of the rows of a text scan (file, split, ...), in file order.

    ``scan`` must be narrow above the file scan. Rows are numbered within their file split
    by their place in the task, so a number depends on the files alone: not on partition
    ids, adaptive execution or a task that is run again. The counts (one row per split) are
    summed up and joined back by a hash of the file's name, so they are small; as the number of
    splits is known from the file listing, they are broadcast up to ``BROADCAST_SPLITS`` and the
    text stays where it is. A split without a count, and two files with one hash, fail the job.
    """
    from pyspark.sql import Window

    tagged = scan.withColumn("_at", F.monotonically_increasing_id()).withColumn("_file", F.xxhash64("file"))
    counts = tagged.groupBy("_file", "split").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.min("file").alias("_name"), F.max("file").alias("_other"))
    before = Window.orderBy("_name", "split").rowsBetween(Window.unboundedPreceding, -1)
    twice = F.raise_error(F.concat(F.lit("one hash for "), F.col("_name"), F.lit(" and "), F.col("_other")))
    offset = F.when(F.col("_name") != F.col("_other"), twice).otherwise(F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select("_file", "split", "_first", offset.cast("long").alias("_offset"))
    splits = len(scan.inputFiles()) + scan.rdd.getNumPartitions()
    out = tagged.join(F.broadcast(counts) if splits <= BROADCAST_SPLITS else counts, ["_file", "split"], "left")
    lost = F.raise_error(F.concat(F.lit("no count for split "), F.col("split").cast("string"), F.lit(" of "), F.col("file")))
    number = F.when(F.col("_offset").isNull(), lost).otherwise(F.col("_offset") + F.col("_at") - F.col("_first"))
    return out.withColumn(name, number.cast("long")).drop("split", "_at", "_offset", "_first", "_file")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, sequence): all non-blank lines, numbered 0.. in file order on the unshuffled scan."""
    return with_sequence(text_lines(spark.read.text(path)))


def with_reason(lines: DataFrame) -> DataFrame:
    """``lines`` with ``v``, the line parsed tolerantly, and ``reason``: null for an object, else why it is none.

    ``malformed`` is no JSON; ``not an object`` names what the JSON is. Each line is parsed once."""
    allow_duplicate_keys(lines.sparkSession)
    rows = lines.withColumn("v", F.try_parse_json("line"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    return rows.withColumn("reason", F.when(F.col("v").isNull(), "malformed").when(
        kind != "OBJECT", F.concat(F.lit("not an object: "), F.lower(kind))))


def read_numbered_records(spark: SparkSession, path: str, strict: bool = True,
                          partitions: int | None = None) -> DataFrame:
    """Object records numbered 0.. in file order (the reference's running sequence),
    with the parsing itself spread over the cluster.

    Object lines are numbered on the unshuffled scan, then spread and parsed; lines that
    are no objects do not consume sequence numbers."""
    scan = object_lines(text_lines(spark.read.text(path)), strict)
    return parse_records(spread(with_sequence(scan), partitions, probe=scan), strict)
