"""Queries of stored and merged summaries, and their SQL (exact: at these sizes the summaries lose nothing)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmart.functions import constants as K
from scanmart.operators import observations as O
from scanmart.operators import sketches as SK
from scanmart.plans import oracle
from scanmart.plans.lines import record_lines
from scanmart.session import shared_path
from scanmart.sources.tables import table


def account_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct IPs and hostnames of each account, merged from stored sketches of single days."""
    obs = O.adapter_observations(table(spark, d, "events"), table(spark, d, "pages"), table(spark, d, "nation"))
    path = shared_path(spark, f"sketches-{uuid.uuid4().hex}")
    SK.account_sketches(obs).write.parquet(path)
    return SK.account_estimates(spark.read.parquet(path))


TOP = 10


def value_top_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The most common values of each raw field as far as bounded summaries are certain of them; parts are merged."""
    records = record_lines(spark, d).select((F.col("sequence") % 3).alias("part"), F.parse_json("value").alias("v"))
    path = shared_path(spark, f"summaries-{uuid.uuid4().hex}")
    for k in range(3):  # three deliveries
        SK.value_summaries(records.where(F.col("part") == k), K.IMPORTANT_FIELDS, TOP).write.mode("append").parquet(path)
    parts = spark.read.parquet(path)
    found = SK.value_top_bounded(SK.merged_summaries(parts, TOP), TOP).where("certain")
    return found.select("field", "rank", "value", F.when(F.col("error") == 0, F.col("records")).alias("records"))


QUERIES = {f.__name__: f for f in (account_estimates, value_top_bounded)}

_TRACKED = SK.tracked_items(TOP) * 3 // 4
ORACLE = {
    "account_estimates": oracle.with_ctes(oracle.ADAPTER) + """
, x AS (SELECT unnest(registrable_domains) AS domain, timestamp, ip_str, hostname FROM obs)
SELECT domain, count(*) AS observation_count, min(try_cast(timestamp AS TIMESTAMP)) AS first_seen,
  max(try_cast(timestamp AS TIMESTAMP)) AS last_seen, count(DISTINCT ip_str) AS unique_ip_estimate,
  count(DISTINCT hostname) AS unique_hostname_estimate
FROM x GROUP BY domain""",
}


def sql(known: dict[str, str]) -> dict[str, str]:
    """The exact list of the fields with fewer values than counters; of the others the values that lead by more than the error."""
    head, _ = known["text_canonical_json"].rsplit("SELECT sequence", 1)
    fields = ", ".join(f"'{f}'" for f in K.IMPORTANT_FIELDS)
    return ORACLE | {"value_top_bounded": head + f"""
, f AS (SELECT x.k AS field, x.v AS value FROM (SELECT unnest(e) AS x FROM kv) WHERE x.k IN ({fields})),
s AS (SELECT field, CASE WHEN length(value) > 120 THEN value[:117] || '...' ELSE value END AS value FROM f),
c AS (SELECT field, value, count(*) AS records FROM s GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY records DESC, value) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY field) AS different, ceil(sum(records) OVER (PARTITION BY field) * 3.5 / {SK.tracked_items(TOP)}) AS error,
  coalesce(lead(records) OVER (PARTITION BY field ORDER BY records DESC, value), 0) AS next FROM c),
z AS (SELECT *, min(CAST(records - error > greatest(next, error) AS INTEGER)) OVER (
  PARTITION BY field ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leads FROM r)
SELECT field, rank, value, CASE WHEN different <= {_TRACKED} THEN records END AS records FROM z
WHERE rank <= {TOP} AND (different <= {_TRACKED} OR leads = 1)"""}
