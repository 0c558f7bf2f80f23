"""Bounded summaries that can be stored and merged: distinct counts, most common values, quantiles.

Beside the exact operators, for tables whose exact state is too large to keep: a sketch a day and
key is written once, and any range of days is answered by merging sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmart.functions import columns as C
from scanmart.functions import constants as K
from scanmart.operators.marts import account_observations
from scanmart.operators.profiling import entries
from scanmart.operators.records import canonical_json

# ------------------------------------------------------------------ distinct counts (HyperLogLog)
#: 2 ** LG_K registers: a relative standard error of about 0.8 %. A sketch has 16 KB at most.
LG_K = 14
DISTINCT = (("unique_ip", "ip_str"), ("unique_hostname", "hostname"))


def account_sketches(observations: DataFrame) -> DataFrame:
    """(domain, day, observation_count, first_seen, last_seen, one sketch for each counted column).

    Hash aggregation by (domain, day), combined map-side: a hot domain ships one sketch a task."""
    rows = account_observations(observations, ["timestamp", *(c for _, c in DISTINCT)])
    ts = F.expr("try_cast(timestamp AS TIMESTAMP_NTZ)")
    return rows.groupBy("domain", F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("observation_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        *(F.hll_sketch_agg(c, LG_K).alias(f"{name}_sketch") for name, c in DISTINCT))


def account_estimates(sketches: DataFrame, keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Sketches of several days (or other parts) merged by ``keys``: counts, and estimates of distinct values."""
    return sketches.groupBy(*keys).agg(
        F.sum("observation_count").alias("observation_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{name}_sketch")), F.lit(0)).cast("bigint").alias(f"{name}_estimate")
          for name, _ in DISTINCT))


# ------------------------------------------------------------------ most common values (frequent items)
def tracked_items(k: int) -> int:
    """Counters of a summary: the least power of two whose three quarters (when a summary is first thinned) hold
    the candidates that a list of ``k`` asks for, max(100, 20 * k)."""
    need, size = max(100, 20 * k), 128
    while size * 3 // 4 < need:
        size *= 2
    return size


def value_summaries(records: DataFrame, fields=K.IMPORTANT_FIELDS, k: int = 10, v_col: str = "v") -> DataFrame:
    """(field, records, summary): the most common display values of each field in a bounded number of counters.

    Summaries can be stored and merged (:func:`merged_summaries`); no task holds more than one a field."""
    e = entries(records, v_col).filter(F.col("key").isin(*fields))
    values = e.select(F.col("key").alias("field"), C.display_value(canonical_json(F.col("value"))).alias("value"))
    return values.groupBy("field").agg(
        F.count(F.lit(1)).alias("records"), F.expr(f"approx_top_k_accumulate(value, {tracked_items(k)})").alias("summary"))


def merged_summaries(parts: DataFrame, k: int = 10) -> DataFrame:
    return parts.groupBy("field").agg(
        F.sum("records").alias("records"), F.expr(f"approx_top_k_combine(summary, {tracked_items(k)})").alias("summary"))


def value_top_bounded(summaries: DataFrame, k: int = 10) -> DataFrame:
    """(field, rank, value, records, error, certain): the ``k`` most common values by their summaries.

    ``records`` is an upper bound of a value's count, too large by ``error`` at most; values that
    have lost their counter occur at most ``error`` times. ``certain``: this value has this rank
    in the exact list, because no summary was thinned (its counters add up to all records), or
    because each value up to here leads the next by more than the error."""
    size = tracked_items(k)
    items = summaries.select("field", F.col("records").alias("total"), F.expr(f"approx_top_k_estimate(summary, {size})").alias("items"))
    whole = (F.size("items") <= size * 3 // 4) & (F.aggregate("items", F.lit(0).cast("bigint"), lambda s, x: s + x["count"]) == F.col("total"))
    rows = items.select("field", whole.alias("whole"), F.when(whole, 0).otherwise(F.ceil(F.col("total") * 3.5 / size)).alias("error"),
                        F.explode("items").alias("x"))
    w = Window.partitionBy("field").orderBy(F.desc("x.count"), "x.item")  # at most ``size`` rows a field
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("x.count").over(w), F.lit(0)))
    apart = F.col("x.count") - F.col("error") > F.greatest(F.col("next"), F.col("error"))
    rows = rows.withColumn("certain", F.col("whole") | F.min(apart).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("rank") <= k).select(
        "field", F.col("rank").cast("int").alias("rank"), F.col("x.item").alias("value"), F.col("x.count").alias("records"), "error", "certain")


# ------------------------------------------------------------------ quantiles (histogram)
#: Values below 2 ** EXACT_BITS have a cell each; above, the first KEPT_BITS binary digits make the cell.
EXACT_BITS, KEPT_BITS = 16, 12


def cell(value: Column) -> Column:
    """The histogram cell of an integer, named by a value in it: itself, or the middle of those that share its
    first binary digits. A cell's value is off by 2 ** -KEPT_BITS of it at most, and there are under 170,000
    cells of either sign, whatever the input."""
    size = F.abs(value)
    shift = F.length(F.bin(size)) - KEPT_BITS
    # shifts by a column are SQL functions
    middle = F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift) + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift - 1)
    return F.when(size < 1 << EXACT_BITS, value).otherwise(F.signum(value).cast("bigint") * middle)


def quantiles(cells: DataFrame, keys: list[str], at: str, weight: str, levels: dict[str, float]) -> DataFrame:
    """(keys, one column a level): interpolated quantiles from a histogram (keys, at, weight).

    Exact where cells are single values. The rows of a key are its cells, counted up in order; no
    buffer of values is held. Null cells do not count."""
    order = Window.partitionBy(*keys).orderBy("_at")
    rows = cells.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(weight).alias("_n"))
    rows = rows.withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy(*keys)))

    def place(level):
        return F.lit(level) * (F.col("_all") - 1)

    found = rows.groupBy(*keys, "_all").agg(*(x for name, level in levels.items() for x in (
        F.min(F.when(F.col("_upto") > F.floor(place(level)), F.col("_at"))).alias(f"_{name}_low"),
        F.min(F.when(F.col("_upto") > F.ceil(place(level)), F.col("_at"))).alias(f"_{name}_high"))))
    return found.select(*keys, *(
        (F.col(f"_{name}_low") + (place(level) - F.floor(place(level))) * (F.col(f"_{name}_high") - F.col(f"_{name}_low"))).alias(name)
        for name, level in levels.items()))
