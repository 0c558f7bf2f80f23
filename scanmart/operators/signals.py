"""Rule-based account signals: narrow per-account projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmart.functions import constants as K

SIGNAL_COLUMNS = (
    "account_id", "domain", "signal_id", "signal_type", "signal_name", "severity", "observed_at",
    "first_seen", "last_seen", "value", "evidence_observation_ids", "confidence", "description",
    "observation_count", "metrics_json",
)

METRIC_KEYS = (
    ("attack_surface_size", "unique_port_count"),
    ("vulnerability_count", "vulnerability_count"),
    ("critical_vulnerability_count", "critical_vulnerability_observations"),
    ("high_vulnerability_count", "high_vulnerability_observations"),
    ("eol_observation_count", "eol_observation_count"),
    ("exposed_database_count", "exposed_database_count"),
    ("exposed_remote_access_count", "exposed_remote_access_count"),
)


def severity_of(signal_type: str, signal_name: str) -> str:
    if signal_name == "critical_vulnerability":
        return "critical"
    return "high" if signal_type in ("vulnerability", "exposure") else "medium"


def account_signals(accounts: DataFrame) -> DataFrame:
    """Six rules per account, unpivoted to one row per rule that fires.

    Null metric counts count as 0 (the reference would fail on them). ``metrics_json``
    is JSON text with the metric keys in fixed order.
    """
    metrics = F.to_json(F.struct(*[F.coalesce(F.col(src).cast("bigint"), F.lit(0)).alias(key)
                                   for key, src in METRIC_KEYS]))
    candidates = []
    for stype, sname, metric, threshold, desc in K.SIGNAL_RULES:
        v = F.coalesce(F.col(metric).cast("bigint"), F.lit(0))
        candidates.append(F.struct(
            (v >= threshold).alias("present"),
            F.lit(stype).alias("signal_type"),
            F.lit(sname).alias("signal_name"),
            F.lit(severity_of(stype, sname)).alias("severity"),
            v.cast("double").alias("value"),
            F.lit(desc).alias("description"),
        ))
    fired = F.filter(F.array(*candidates), lambda s: s["present"])
    rows = accounts.select("account_id", "domain", "last_seen", "observation_count",
                           metrics.alias("metrics_json"), F.explode(fired).alias("s"))
    return rows.select(
        "account_id", "domain",
        F.sha1(F.concat_ws(":", F.col("account_id"), F.col("s.signal_name"))).alias("signal_id"),
        F.col("s.signal_type").alias("signal_type"),
        F.col("s.signal_name").alias("signal_name"),
        F.col("s.severity").alias("severity"),
        F.col("last_seen").alias("observed_at"),
        F.lit(None).cast("timestamp_ntz").alias("first_seen"),
        "last_seen",
        F.col("s.value").alias("value"),
        F.array().cast("array<string>").alias("evidence_observation_ids"),
        F.lit(0.9).alias("confidence"),
        F.col("s.description").alias("description"),
        "observation_count",
        "metrics_json",
    )


def severity_rank(c: str = "severity"):
    """critical 1, high 2, anything else 3."""
    return F.when(F.col(c) == "critical", 1).when(F.col(c) == "high", 2).otherwise(3)


def ranked_signals(signals: DataFrame) -> DataFrame:
    """Signals ordered by severity rank, then domain and name (dashboard order)."""
    return (signals.withColumn("severity_rank", severity_rank())
            .orderBy("severity_rank", "domain", "signal_name"))
