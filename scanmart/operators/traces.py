"""LLM call traces: cost estimation, enrichment, roll-ups and the rolling 24 h spend."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanmart.functions import constants as K
from scanmart.operators import sketches


def rates(spark: SparkSession) -> DataFrame:
    """Model rate table (USD per 1M tokens); fixed size, broadcast in joins."""
    return spark.createDataFrame(list(K.RATES_PER_MILLION), "model string, input_rate double, output_rate double")


def with_cost(traces: DataFrame, rate_table: DataFrame) -> DataFrame:
    """cost_usd = round(in/1e6*rate_in + out/1e6*rate_out, 6); unknown model -> default rate.

    Computed in exact decimals and rounded half-up, so ties do not depend on binary
    floating-point error (the only difference to a float computation is at exact ties)."""
    j = traces.join(F.broadcast(rate_table), "model", "left")
    rin = F.coalesce(F.col("input_rate"), F.lit(K.DEFAULT_RATE[0]))
    rout = F.coalesce(F.col("output_rate"), F.lit(K.DEFAULT_RATE[1]))
    # exact decimal arithmetic, then half-up to 6 places (deterministic on every engine)
    dec = lambda c, t: c.cast(t)
    micro = F.lit(Decimal("0.000001"))
    cost = F.round((dec(F.col("input_tokens"), "decimal(20,0)") * dec(rin, "decimal(10,4)")
                    + dec(F.col("output_tokens"), "decimal(20,0)") * dec(rout, "decimal(10,4)")) * micro, 6
                   ).cast("double")
    return j.withColumn("cost_usd", cost).drop("input_rate", "output_rate")


def enrich(traces: DataFrame) -> DataFrame:
    """provider from the model prefix; decision ``{workflow}_generated`` / ``_failed``."""
    provider = (F.when(F.col("model").startswith("claude"), "claude")
                .when(F.col("model").startswith("gemini"), "gemini").otherwise("unknown"))
    ok = F.coalesce(F.length("response") > 0, F.lit(False)) & F.col("error").isNull()
    decision = F.concat(F.col("workflow"), F.when(ok, F.lit("_generated")).otherwise(F.lit("_failed")))
    return traces.withColumn("provider", provider).withColumn("decision", decision)


#: Output column -> level of the latency percentiles.
LATENCY_LEVELS = {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}


def latency_cells(traces: DataFrame) -> DataFrame:
    """(workflow, provider, day, cell, sums): calls by latency cell (:func:`scanmart.operators.sketches.cell`).

    One row a cell, combined map-side, at most 170,000 a group whatever the number of calls; rows
    of several parts are merged by adding them up."""
    return traces.groupBy("workflow", "provider", F.to_date("timestamp").alias("day"), sketches.cell(F.col("latency_ms").cast("bigint")).alias("cell")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")).alias("micros"),
        F.count("cached").alias("asked"), F.count_if("cached").alias("hits"), F.count("error").alias("errors"))


def rollup(traces: DataFrame) -> DataFrame:
    """Per workflow, provider and day: calls, spend (summed in integer micro-dollars, so
    the total does not depend on summation order), cache-hit and error rates, latency
    percentiles (interpolated; exact below 65.536 s, above it off by 1/4096 at most).

    All from the latency cells: one aggregation of the calls, no buffer of latencies per group."""
    keys = ["workflow", "provider", "day"]
    cells = latency_cells(traces)
    sums = cells.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("calls", "micros", "asked", "hits", "errors")))
    p = sketches.quantiles(cells, keys, "cell", "calls", LATENCY_LEVELS)
    both = sums.alias("s").join(p.alias("p"), [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], "left")
    return both.select(
        *(F.col(f"s.{k}") for k in keys), "calls", (F.col("micros") / 1e6).alias("spend_usd"),
        F.round(F.try_divide("hits", "asked"), 4).alias("cache_hit_rate"),
        F.round(F.col("errors") / F.col("calls"), 4).alias("error_rate"), *(F.round(c, 3).alias(c) for c in LATENCY_LEVELS))


def rolling_cost(traces: DataFrame, hours: int = 24, threshold: float = 2.0) -> DataFrame:
    """Spend per workflow in the trailing ``hours`` window ending at each hour, with an
    alert flag above ``threshold`` USD.

    Calls are first pre-aggregated to (workflow, hour) - a hot workflow collapses to one
    row per hour before any window - then a range window over the hour index sums the
    trailing buckets (rows per workflow = hours covered, not calls)."""
    hourly = (traces.groupBy("workflow", F.date_trunc("hour", "timestamp").alias("hour"))
              .agg(F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")).alias("_c"), F.count(F.lit(1)).alias("_n")))
    idx = (F.unix_seconds(F.col("hour").cast("timestamp")) / 3600).cast("bigint")
    w = Window.partitionBy("workflow").orderBy(idx).rangeBetween(-(hours - 1), 0)
    return hourly.select(
        "workflow", "hour",
        (F.sum("_c").over(w) / 1e6).alias("cost_24h_usd"),
        F.sum("_n").over(w).alias("calls_24h"),
    ).withColumn("alert", F.col("cost_24h_usd") > threshold)


# fixed values of the events -> traces mapping (FIXTURES.md section 3)
TRACE_MODELS = ("gemini-2.5-flash", "claude-3-5-haiku-20241022", "unlisted-model")


def traces_from_events(events: DataFrame) -> DataFrame:
    """Trace rows derived from events: event_type -> workflow, user_id -> account,
    value -> tokens, ts -> time; ``error`` events failed."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    models = F.array(*[F.lit(m) for m in TRACE_MODELS])
    return events.select(
        F.col("event_id").alias("trace_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("workflow"),
        F.concat(F.lit("audit/v"), (F.lit(1) + k % 2).cast("string")).alias("prompt_version"),
        F.element_at(models, (F.lit(1) + k % 3).cast("int")).alias("model"),
        F.concat(F.lit("account-"), F.col("user_id").cast("string")).alias("domain"),
        (F.col("value") * 100).cast("bigint").alias("input_tokens"),
        (F.col("value") * 40).cast("bigint").alias("output_tokens"),
        (k * 10).alias("latency_ms"),
        (k % 5 == 0).alias("cached"),
        F.when(F.col("event_type") == "error", F.lit("provider error")).alias("error"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("response"),
    )


def cost_model(traces: DataFrame) -> DataFrame:
    """Per workflow and model: calls, mean input/output tokens, mean cost per call and
    total spend (micro-dollar sums) - the cost table of the planning documents, measured."""
    return (traces.groupBy("workflow", "model")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.round(F.avg("input_tokens"), 2).alias("avg_input_tokens"),
                 F.round(F.avg("output_tokens"), 2).alias("avg_output_tokens"),
                 F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")).alias("_c"))
            .select("workflow", "model", "calls", "avg_input_tokens", "avg_output_tokens",
                    F.round(F.col("_c") / F.col("calls") / 1e6, 8).alias("cost_per_call_usd"),
                    (F.col("_c") / 1e6).alias("total_cost_usd")))
