"""Top accounts, per-account evidence and the account context document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_KEYS = (
    "observation_count", "unique_ip_count", "unique_hostname_count", "unique_port_count",
    "unique_service_count", "vulnerability_count", "critical_vulnerability_observations",
    "high_vulnerability_observations", "eol_observation_count", "exposed_database_count",
    "exposed_remote_access_count", "cloud_observation_count", "identified_cloud_observation_count",
)
SCORE_KEYS = ("icp_score", "exposure_score", "vulnerability_score", "technology_score", "recency_score",
              "opportunity_score")
EVIDENCE_COLUMNS = ("observation_id", "timestamp", "ip_str", "port", "service_category", "product", "version",
                    "vuln_count", "vuln_max_cvss", "cloud_provider", "detected_technologies")


def top_accounts(scored: DataFrame, limit: int = 1000) -> DataFrame:
    """Score desc, domain asc, first ``limit`` (planned as TakeOrderedAndProject)."""
    return scored.orderBy(F.desc("opportunity_score"), F.asc("domain")).limit(limit)


def ranked_accounts(scored: DataFrame) -> DataFrame:
    """All accounts in score order (global sort; range-partitioned by Spark)."""
    return scored.orderBy(F.desc("opportunity_score"), F.asc("domain"))


def account_evidence(observations: DataFrame, selected: DataFrame, per_account: int = 5) -> DataFrame:
    """Top-K observations per selected account by CVSS desc (nulls last), time desc.

    ``selected`` is the top-N selection; Spark picks the semi join by its size.
    The rank filter is planned as a WindowGroupLimit, which trims each map partition to
    K rows per domain before the shuffle, so a hot domain ships only K rows per task.
    """
    cols = [c for c in EVIDENCE_COLUMNS if c in observations.columns]
    ev = (observations.filter(F.size("registrable_domains") > 0)
          .select(F.explode("registrable_domains").alias("domain"), *cols))
    keys = selected.select("domain").distinct()
    ev = ev.join(keys, "domain", "left_semi")
    w = Window.partitionBy("domain").orderBy(F.desc_nulls_last("vuln_max_cvss"), F.desc("timestamp"),
                                             F.asc("observation_id"))
    return ev.withColumn("evidence_rank", F.row_number().over(w)).filter(F.col("evidence_rank") <= per_account)


def account_context(selected: DataFrame, signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per selected account: account, metrics, scores, signals[], evidence[].

    Signals and evidence are grouped per domain (both bounded: 6 rules, K evidence rows),
    then left-joined; missing lists become ``[]``. Lists are ordered by sort keys that
    lead each struct (severity, signal name / evidence rank).
    """
    sig = (signals.join(selected.select("domain"), "domain", "left_semi")
           .groupBy("domain")
           .agg(F.array_sort(F.collect_list(F.struct(
               "severity", "signal_name", "signal_id", "signal_type", "value", "confidence", "description",
               "observed_at"))).alias("signals")))
    ev_cols = [c for c in EVIDENCE_COLUMNS if c in evidence.columns]
    evd = (evidence.groupBy("domain")
           .agg(F.array_sort(F.collect_list(F.struct("evidence_rank", *ev_cols))).alias("evidence")))
    ctx = (selected.join(sig, "domain", "left").join(evd, "domain", "left"))
    return ctx.select(
        "domain",
        F.struct("account_id", "domain", "first_seen", "last_seen").alias("account"),
        F.struct(*METRIC_KEYS).alias("metrics"),
        F.struct(*SCORE_KEYS).alias("scores"),
        F.coalesce("signals", F.array().cast(sig.schema["signals"].dataType)).alias("signals"),
        F.coalesce("evidence", F.array().cast(evd.schema["evidence"].dataType)).alias("evidence"),
    )


def context_flat(context: DataFrame) -> DataFrame:
    """Flat, comparable view of the context: metrics/scores columns + ordered id lists."""
    return context.select(
        "domain", "account.account_id", "account.first_seen", "account.last_seen", "metrics.*", "scores.*",
        F.transform("signals", lambda s: s["signal_id"]).alias("signal_ids"),
        F.transform("evidence", lambda e: e["observation_id"]).alias("evidence_observation_ids"),
    )


def context_json(context: DataFrame) -> DataFrame:
    """One JSON document per account (value column ``context``), for a text/JSONL sink."""
    return context.select("domain", F.to_json(F.struct("account", "metrics", "scores", "signals", "evidence"))
                          .alias("context"))
