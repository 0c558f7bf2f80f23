"""Deterministic, explainable account scores (narrow projection + one 1-row broadcast)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from scanmart.operators.scalars import attach

from scanmart.functions import columns as C


def reference_time(accounts: DataFrame) -> DataFrame:
    """1-row frame: latest ``last_seen`` of the whole table, or now when none exists."""
    return accounts.agg(F.coalesce(F.max("last_seen"), F.localtimestamp()).alias("reference_time"))


def exposure_score() -> Column:
    return C.bounded(F.lit(60.0) * C.log_score(F.col("unique_port_count"), 10) / 100.0
                     + F.lit(20.0) * C.log_score(F.col("exposed_database_count"), 3) / 100.0
                     + F.lit(20.0) * C.log_score(F.col("exposed_remote_access_count"), 3) / 100.0)


def vulnerability_score() -> Column:
    return C.bounded(F.lit(55.0) * C.log_score(F.col("critical_vulnerability_observations"), 1) / 100.0
                     + F.lit(30.0) * C.log_score(F.col("high_vulnerability_observations"), 3) / 100.0
                     + F.lit(15.0) * C.log_score(F.col("vulnerability_count"), 10) / 100.0)


def technology_score() -> Column:
    ntech = F.when(F.col("technologies").isNull(), F.lit(0)).otherwise(F.size("technologies"))
    return C.bounded(F.lit(70.0) * C.log_score(ntech, 5) / 100.0
                     + F.lit(30.0) * C.log_score(F.col("unique_service_count"), 5) / 100.0)


def recency_score() -> Column:
    """100*exp(-age_days/30) against the dataset reference time; no last_seen -> 0."""
    age_days = F.greatest(F.lit(0.0), F.expr("timestampdiff(MICROSECOND, last_seen, reference_time)")
                          .cast("double") / 86400e6)
    return F.when(F.col("last_seen").isNull(), F.lit(0.0)).otherwise(
        C.bounded(F.lit(100.0) * F.exp(-age_days / 30.0)))


def score_reasons() -> Column:
    crit = C.zero("critical_vulnerability_observations")
    db = C.zero("exposed_database_count")
    remote = C.zero("exposed_remote_access_count")
    eol = C.zero("eol_observation_count")
    ports = C.zero("unique_port_count")
    texts = F.array(
        F.when(crit != 0, F.concat(crit.cast("string"), F.lit(" critical vulnerability observations"))),
        F.when(db != 0, F.concat(db.cast("string"), F.lit(" exposed database observations"))),
        F.when(remote != 0, F.concat(remote.cast("string"), F.lit(" exposed remote-access observations"))),
        F.when(eol != 0, F.concat(eol.cast("string"), F.lit(" EOL observations"))),
        F.when(ports >= 10, F.concat(ports.cast("string"), F.lit(" unique exposed ports"))),
    )
    return F.to_json(F.filter(texts, lambda t: t.isNotNull()))


def scored_accounts(accounts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """accounts + icp/exposure/vulnerability/technology/recency/opportunity + reasons.

    The dataset-wide reference time is a 1-row aggregate joined back by broadcast (its
    size is fixed at one row); everything else is a narrow projection. ``seen`` has in ``last_seen``
    the times that the accounts' are the latest of (:func:`marts.sightings`): where the accounts are many,
    their latest time is found there without shuffling their facts for it once more.
    """
    ref = reference_time(accounts if seen is None else seen)
    a = attach(accounts, ref)
    icp = C.icp_score(F.col("unique_ip_count"), F.col("unique_service_count"), F.col("technologies"),
                      F.col("cloud_observation_count"), F.col("countries"))
    scored = (a.withColumn("icp_score", icp)
               .withColumn("exposure_score", exposure_score())
               .withColumn("vulnerability_score", vulnerability_score())
               .withColumn("technology_score", technology_score())
               .withColumn("recency_score", recency_score()))
    # components have two decimals and weights one, so ties are common: rounded as decimals
    opp = F.round((C.weighted_opportunity(F.col("icp_score"), F.col("exposure_score"),
                                         F.col("vulnerability_score"), F.col("technology_score"),
                                         F.col("recency_score"))).cast("decimal(20,9)"), 2).cast("double")
    return (scored.withColumn("opportunity_score", opp)
                  .withColumn("score_reasons", score_reasons())
                  .drop("reference_time"))


def opportunity_library(components: DataFrame) -> DataFrame:
    """Library form: weighted sum of the five components, missing = 0, capped at 100, not rounded."""
    total = C.weighted_opportunity(F.col("icp_score"), F.col("exposure_score"), F.col("vulnerability_score"),
                                   F.col("technology_score"), F.col("recency_score"))
    return components.withColumn("opportunity_library_score", F.least(F.lit(100.0), total))


def qualified(scored: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Qualification rule: opportunity score >= threshold (missing = 0)."""
    return scored.filter(F.coalesce(F.col("opportunity_score"), F.lit(0.0)) >= threshold)


def score_distribution(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("accounts"),
                      F.min("opportunity_score").alias("min_score"),
                      F.round(F.avg("opportunity_score"), 2).alias("avg_score"),
                      F.max("opportunity_score").alias("max_score"))
