"""Account, service and organisation marts: one scan each; the services mart is one
shuffle on (domain, service), the account and organisation marts two hash-aggregate
levels ((key, kind, value), then key) with no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCOUNT_COLUMNS = (
    "account_id", "domain", "first_seen", "last_seen", "observation_count", "unique_ip_count",
    "unique_hostname_count", "unique_port_count", "unique_service_count", "cloud_observation_count",
    "identified_cloud_observation_count", "countries", "regions", "cloud_providers", "technologies",
    "services", "vulnerability_count", "critical_vulnerability_observations",
    "high_vulnerability_observations", "eol_observation_count", "exposed_database_count",
    "exposed_remote_access_count",
)


def _ts(c: str):
    return F.expr(f"try_cast({c} AS TIMESTAMP_NTZ)")


def _null_if_empty(arr):
    return F.when(F.size(arr) > 0, arr)


def account_observations(observations: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per (registrable domain, observation): the exploded value is ``domain``.

    ``explode`` drops null and empty lists, so the non-empty filter is implied; it is
    still stated so the scan can skip such rows early.
    """
    obs = observations.drop("domain") if "domain" in observations.columns else observations
    keep = [c for c in (columns or obs.columns) if c != "registrable_domains"]
    return (obs.filter(F.col("registrable_domains").isNotNull() & (F.size("registrable_domains") > 0))
               .select(F.explode("registrable_domains").alias("domain"), *keep))


def sightings(observations: DataFrame) -> DataFrame:
    """``last_seen`` of every observation of an account: the accounts' are the latest of each, so the latest of all is the same."""
    return (observations.filter(F.col("registrable_domains").isNotNull() & (F.size("registrable_domains") > 0))
            .select(_ts("timestamp").alias("last_seen")))


# counted values without a bound per domain: one row each
COUNTED = (("unique_ip_count", "ip_str"), ("unique_hostname_count", "hostname"))
# values of bounded vocabularies that ride on the main row: (output, column, listed, empty list -> null)
CARRIED = (("unique_port_count", "port", False, False), ("unique_service_count", "service_category", False, False),
           ("countries", "country_code", True, True), ("regions", "region_code", True, True),
           ("cloud_providers", "cloud_provider", True, True))
# list columns: (output, column)
LISTED = (("technologies", "detected_technologies"), ("services", "detected_services"))
MAIN = -1  # kind of the one row per observation that carries the additive measures


# additive measures of the first level: (output, how it is merged)
MEASURES = (("first_seen", "min"), ("last_seen", "max"), ("observation_count", "sum"), ("cloud_observation_count", "sum"),
            ("identified_cloud_observation_count", "sum"), ("vulnerability_count", "sum"),
            ("critical_vulnerability_observations", "sum"), ("high_vulnerability_observations", "sum"),
            ("eol_observation_count", "sum"), ("exposed_database_count", "sum"), ("exposed_remote_access_count", "sum"))
#: Columns and types of the first level.
FACT_SCHEMA = ("domain string, k int, v string, port int, service_category string, country_code string, region_code string, "
               "cloud_provider string, first_seen timestamp_ntz, last_seen timestamp_ntz, "
               + ", ".join(f"{name} bigint" for name, how in MEASURES if how == "sum"))


def accounts_mart(observations: DataFrame) -> DataFrame:
    """Group observations by registrable domain; 20 aggregates, one scan, no join.

    Two levels: :func:`account_facts` and :func:`accounts_of`."""
    return accounts_of(account_facts(observations))


def account_facts(observations: DataFrame) -> DataFrame:
    """First level of the account mart: (domain, kind, value, carried values) with additive measures.

    Every (domain, observation) row becomes a *main* row (kind -1) with the additive measures
    and the values of bounded vocabularies (port, service category, country, region,
    provider), one row each for its IP and hostname, and one per technology and service.
    They are grouped by (domain, kind, value, carried values) with declarative aggregates only
    (hash aggregation, combined map-side): main rows fold into one row per combination of
    carried values, the others into one row per distinct value. The shuffle is keyed by the
    value too, so a hot domain's IPs and hostnames spread over every reducer. An observation
    makes three rows and its list items (Spark's Expand plan for several DISTINCT aggregates:
    five). Facts of several sets of observations can be merged (:func:`merged_facts`).
    """
    need = ["timestamp", "ip_str", "hostname", "port", "service_category", "cloud_present", "cloud_provider",
            "country_code", "region_code", "detected_technologies", "detected_services", "vuln_count",
            "vuln_max_cvss", "has_eol_tag", "database_service_count", "remote_access_service_count"]
    ao = account_observations(observations, need)

    cvss = F.col("vuln_max_cvss")
    cloud = F.coalesce(F.col("cloud_present"), F.lit(False))
    measures = (
        ("ts", _ts("timestamp")),
        ("cloud", F.when(cloud, 1)),
        ("identified", F.when(cloud & F.col("cloud_provider").isNotNull(), 1)),
        ("vulns", F.col("vuln_count").cast("bigint")),
        ("critical", F.when(cvss >= 9.0, 1).otherwise(0)),
        ("high", F.when((cvss >= 7.0) & (cvss < 9.0), 1).otherwise(0)),
        ("eol", F.when(F.col("has_eol_tag"), 1).otherwise(0)),
        ("db", F.col("database_service_count").cast("bigint")),
        ("remote", F.col("remote_access_service_count").cast("bigint")),
    )
    no_measures = [F.lit(None).cast(t).alias(name) for (name, _), t in
                   zip(measures, ("timestamp_ntz", "int", "int", "bigint", "int", "int", "int", "bigint", "bigint"))]

    carried = [c for _, c, _, _ in CARRIED]
    kinds = ao.select(*carried).schema

    def tagged(c: str, k: int, is_array: bool):
        value = F.lit(None).cast("string") if is_array else F.col(c).cast("string")
        values = F.col(c) if is_array else F.lit(None).cast("array<string>")
        return F.struct(F.lit(k).alias("k"), value.alias("v"), values.alias("vs"),
                        *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds], *no_measures)

    # built-in generators and struct/array constructors only (whole-stage codegen; no
    # lambda functions): one struct per kind, then one row per value of a list kind
    main = F.struct(F.lit(MAIN).alias("k"), F.lit(None).cast("string").alias("v"),
                    F.lit(None).cast("array<string>").alias("vs"), *carried, *[c.alias(name) for name, c in measures])
    n = len(COUNTED)
    kv = F.array(main, *[tagged(c, i, False) for i, (_, c) in enumerate(COUNTED)],
                 *[tagged(c, n + j, True) for j, (_, c) in enumerate(LISTED)])
    rows = (ao.select("domain", F.explode(kv).alias("x"))
              .select("domain", "x.*")
              .select("domain", "k", F.explode_outer(F.coalesce("vs", F.array("v"))).alias("v"), *carried,
                      *[name for name, _ in measures])
              .filter((F.col("k") == MAIN) | F.col("v").isNotNull()))
    return rows.groupBy("domain", "k", "v", *carried).agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count(F.when(F.col("k") == MAIN, 1)).alias("observation_count"),
        F.count("cloud").alias("cloud_observation_count"),
        F.count("identified").alias("identified_cloud_observation_count"),
        F.sum("vulns").alias("vulnerability_count"),
        F.sum("critical").alias("critical_vulnerability_observations"),
        F.sum("high").alias("high_vulnerability_observations"),
        F.sum("eol").alias("eol_observation_count"),
        F.sum("db").alias("exposed_database_count"),
        F.sum("remote").alias("exposed_remote_access_count"),
    )


def merged_facts(facts: DataFrame) -> DataFrame:
    """The facts of the union of the observations that ``facts`` come from (several rows for one key as one)."""
    merge = {"min": F.min, "max": F.max, "sum": F.sum}
    return facts.groupBy("domain", "k", "v", *(c for _, c, _, _ in CARRIED)).agg(*(merge[how](name).alias(name) for name, how in MEASURES))


def accounts_of(facts: DataFrame) -> DataFrame:
    """Second level of the account mart, by domain: sums of the main rows, a count per counted kind
    and sets of bounded vocabularies. No per-domain set of IPs is held anywhere."""
    n = len(COUNTED)
    agg = facts.groupBy("domain").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        *[F.sum(c).cast("bigint").alias(c) for c, how in MEASURES if how == "sum"],
        *[F.count_if(F.col("k") == i).cast("bigint").alias(name) for i, (name, _) in enumerate(COUNTED)],
        *[F.array_sort(F.collect_set(c)).alias(name) for name, c, _, _ in CARRIED],
        *[F.array_sort(F.collect_list(F.when(F.col("k") == n + j, F.col("v")))).alias(name)
          for j, (name, _) in enumerate(LISTED)],
    )
    shown = {name: F.size(name).cast("bigint") if not listed else _null_if_empty(F.col(name)) if empty_null else F.col(name)
             for name, _, listed, empty_null in CARRIED}
    rest = [F.col(c) for c in ACCOUNT_COLUMNS if c != "account_id" and c not in shown]
    return agg.select(F.col("domain").alias("account_id"), *rest, *[c.alias(name) for name, c in shown.items()]).select(
        *ACCOUNT_COLUMNS)


def services_mart(observations: DataFrame) -> DataFrame:
    """Group by (domain, detected service): count, first/last seen (double lateral unnest)."""
    ds = (observations
          .filter((F.size("registrable_domains") > 0) & (F.size("detected_services") > 0))
          .select(F.explode("registrable_domains").alias("domain"), "detected_services", "timestamp")
          .filter(F.col("domain").isNotNull())
          .select("domain", F.explode("detected_services").alias("service"), "timestamp"))
    return (ds.groupBy("domain", "service")
              .agg(F.count(F.lit(1)).alias("observation_count"),
                   F.min(_ts("timestamp")).alias("first_seen"),
                   F.max(_ts("timestamp")).alias("last_seen"))
              .select(F.col("domain").alias("account_id"), "domain", "service", "observation_count",
                      "first_seen", "last_seen"))


def org_mart(observations: DataFrame, ip_col: str = "ip_str") -> DataFrame:
    """Group by canonical_org: observations, distinct IPs, latest timestamp text.

    The reference keeps the distinct IPs as one list per organisation. A hot
    organisation's IP list is unbounded, so the mart carries the exact distinct count
    and :func:`org_ips` gives the (org, ip) pairs as a long table. One scan, two
    hash-aggregate levels as in :func:`accounts_mart`: every observation becomes a
    main row (count, latest text) and an IP row; level 1 groups by (org, kind, ip), so a
    hot organisation's IPs spread over all reducers, level 2 by the organisation.
    """
    o = observations.filter(F.col("canonical_org").isNotNull())
    ts_type = o.schema["timestamp"].dataType
    kv = F.array(F.struct(F.lit(MAIN).alias("k"), F.lit(None).cast("string").alias("v"),
                          F.col("timestamp").alias("ts")),
                 F.struct(F.lit(0).alias("k"), F.col(ip_col).cast("string").alias("v"),
                          F.lit(None).cast(ts_type).alias("ts")))
    rows = (o.select("canonical_org", F.explode(kv).alias("x")).select("canonical_org", "x.*")
             .filter((F.col("k") == MAIN) | F.col("v").isNotNull()))
    level1 = rows.groupBy("canonical_org", "k", "v").agg(
        F.count(F.when(F.col("k") == MAIN, 1)).alias("observation_count"), F.max("ts").alias("last_observed_at"))
    return level1.groupBy("canonical_org").agg(
        F.sum("observation_count").cast("bigint").alias("observation_count"),
        F.count_if(F.col("k") == 0).cast("bigint").alias("unique_ip_count"),
        F.max("last_observed_at").alias("last_observed_at"))


def org_ips(observations: DataFrame, ip_col: str = "ip_str") -> DataFrame:
    """Distinct (canonical_org, ip) pairs: the long form of the org mart's IP list."""
    return (observations.filter(F.col("canonical_org").isNotNull() & F.col(ip_col).isNotNull())
            .select("canonical_org", F.col(ip_col).alias("ip")).distinct())
