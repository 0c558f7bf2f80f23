"""Helpers of the text operators: batch slicing, word splitting, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmart.session import shared_path

#: The white space between words, as a Java / RE2 character class body.
WORD_SPACE = r"\x20\x09-\x0D"
#: Bytes of text that a task takes into Python objects at a time.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts`` (null id: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a fresh table in the shared checkpoint folder and read again.

    Cuts the lineage: a lost executor re-reads files instead of re-running the plan.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot with more rows than this, and than the total divided by half of ``HOT_KEYS``.
HOT_ROWS, HOT_KEYS = 1000, 1 << 16


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and in ``weight`` the number of rows of ``left`` with that key.

    Rows of hot keys meet a broadcast copy of their few right rows: as the weights add up to
    ``total`` at most, there are never more than HOT_KEYS / 2 of them. The others are shuffled,
    and none of their keys is large. ``weight`` is left out of the result."""
    limit = max(HOT_ROWS, 2 * total // HOT_KEYS)
    hot, cold = right.where(F.col(weight) > limit).drop(weight), right.where(F.col(weight) <= limit).drop(weight)
    if not hot.limit(1).count():
        return left.join(cold, key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).select(*rest.columns).unionByName(rest)


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column (null: None), without making Python strings."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def key64(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (SplitMix64's finisher)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
