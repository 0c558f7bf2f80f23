"""Curated observations: one row per scan record.

Two producers share the derived columns:

* :func:`adapter_observations` derives observations from the driver tables
  (events x pages x nation, FIXTURES.md section 2) so every downstream mart can be
  checked against an independent SQL oracle.
* :func:`records_to_observations` (in ``scanmart.operators.records``) normalizes raw
  JSON records held as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmart.functions import columns as C
from scanmart.functions import constants as K

# fixed values of the table adapter (FIXTURES.md section 2)
ADAPTER_PORTS = (443, 80, 22, 3306, 5432, 6379, 3389, 21, 25, 53, 9200, 23, 8080, 554)
ADAPTER_CLICK_TECHS = ("ssh", "redis", "mysql", "ftp")
TIMESTAMP_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def page_hosts(pages: DataFrame) -> DataFrame:
    """(page_id, host): lower-cased URL authority without port."""
    return pages.select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"))


def observation_id(seq: Column, ip_str: Column, ts_text: Column, port: Column) -> Column:
    """sha1 of ``"{seq}:{ip_str}:{timestamp}:{port}"``; missing parts print as ``None``."""
    none = F.lit("None")
    return F.sha1(F.concat_ws(":", F.coalesce(seq.cast("string"), none), F.coalesce(ip_str, none),
                              F.coalesce(ts_text, none), F.coalesce(port.cast("string"), none)))


def with_service_columns(df: DataFrame) -> DataFrame:
    """service_category from port; detected_services and the service-count columns."""
    services = C.detected_services("detected_technologies")
    return (df.withColumn("service_category", C.service_category("port"))
              .withColumn("detected_services", services)
              .withColumn("service_count", F.size("detected_services"))
              .withColumn("sensitive_service_count",
                          C.count_in("detected_services", K.DATABASE_SERVICES + K.REMOTE_ACCESS_SERVICES))
              .withColumn("remote_access_service_count", C.count_in("detected_services", K.REMOTE_ACCESS_SERVICES))
              .withColumn("database_service_count", C.count_in("detected_services", K.DATABASE_SERVICES)))


def adapter_observations(events: DataFrame, pages: DataFrame, nation: DataFrame) -> DataFrame:
    """Observations derived from the driver tables.

    Plan: the page count is a scalar subquery (one value, computed once); the two
    page-host lookups are equi-joins on ``page_id`` whose strategy AQE picks from
    runtime sizes (broadcast only under ``autoBroadcastJoinThreshold``); ``nation`` is a
    25-row dimension. Events are never shuffled when the host side is small.
    """
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    hosts = page_hosts(pages)
    a = hosts.select(F.col("page_id").alias("a_page_id"), F.col("host").alias("a_host"))
    b = hosts.select(F.col("page_id").alias("b_page_id"), F.col("host").alias("b_host"))
    e = (events
         .select("event_id", "ts", "user_id", "event_type", "value",
                 F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                 (F.col("event_id") % n_pages).alias("p1"),
                 ((F.col("event_id") + 1) % n_pages).alias("p2")))
    nat = nation.select(F.col("n_nationkey"), F.col("n_name"))
    j = (e.join(a, e.p1 == a.a_page_id)
          .join(b, e.p2 == b.b_page_id)
          .join(F.broadcast(nat), nat.n_nationkey == (e.user_id % 25)))

    hosts_arr = F.when(F.col("event_id") % 10 == 0, F.array("a_host", "b_host")).otherwise(F.array("a_host"))
    reg = F.array_sort(F.array_distinct(F.filter(
        F.transform(hosts_arr, lambda x: F.regexp_extract(x, r"([^.]+\.example\.(com|org|net))$", 1)),
        lambda x: x.isNotNull())))
    ports = F.array(*[F.lit(p) for p in ADAPTER_PORTS])
    port = F.element_at(ports, (F.lit(1) + F.col("k") % (F.lit(1) + F.col("p1") % 14)).cast("int"))
    is_error_vuln = (F.col("event_type") == "error") & (F.col("p1") % 3 == 0)
    techs = (F.when((F.col("event_type") == "click") & (F.col("p1") % 4 == 0),
                    F.array(F.element_at(C.str_array(ADAPTER_CLICK_TECHS), (F.lit(1) + F.col("k") % 4).cast("int"))))
             .when(F.col("event_type") == "click", F.array(F.lit("nginx_status")))
             .otherwise(F.array().cast("array<string>")))
    ts_text = F.date_format("ts", TIMESTAMP_TEXT)
    ip_str = F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."),
                      (F.col("user_id") % 256).cast("string"))

    obs = j.select(
        F.col("event_id"),
        F.col("user_id"),
        F.col("k"),
        ts_text.alias("timestamp"),
        ip_str.alias("ip_str"),
        F.col("a_host").alias("hostname"),
        reg.alias("registrable_domains"),
        port.cast("int").alias("port"),
        F.col("n_name").alias("country_code"),
        F.lit(None).cast("string").alias("region_code"),
        (F.col("event_type") == "view").alias("cloud_present"),
        F.when((F.col("event_type") == "view") & (F.col("k") % 2 == 0), F.lit("AWS")).alias("cloud_provider"),
        F.when(is_error_vuln, F.lit(1) + F.col("k") % 3).otherwise(F.lit(0)).cast("int").alias("vuln_count"),
        F.when(is_error_vuln, F.least(F.lit(10.0), F.round(F.col("value") / 15, 1))).alias("vuln_max_cvss"),
        ((F.col("event_type") == "signup") & (F.col("p1") % 5 == 0)).alias("has_eol_tag"),
        techs.alias("detected_technologies"),
    )
    obs = with_service_columns(obs)
    return obs.withColumn("observation_id", observation_id(F.col("event_id"), F.col("ip_str"),
                                                           F.col("timestamp"), F.col("port")))


# fixed values of the table adapter: legal-form endings appended to customer names
ADAPTER_ORG_ENDINGS = (" Inc", " LLC", " & Co", "")


def with_orgs(obs: DataFrame, customer: DataFrame) -> DataFrame:
    """Adds ``org`` (customer name + a legal-form ending chosen by ``k % 4``) and
    ``canonical_org``. Equi-join on the customer key; AQE picks the strategy from sizes."""
    endings = C.str_array(ADAPTER_ORG_ENDINGS)
    cust = customer.select(F.col("c_custkey"), F.col("c_name"))
    j = obs.join(cust, obs.user_id == cust.c_custkey).drop("c_custkey")
    org = F.concat(F.col("c_name"), F.element_at(endings, (F.lit(1) + F.col("k") % 4).cast("int")))
    return (j.withColumn("org", org).drop("c_name")
             .withColumn("canonical_org", C.normalize_org_ascii(F.col("org"))))


def _kv(key: str, json_value: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), json_value)


def raw_records(obs_with_orgs: DataFrame) -> DataFrame:
    """Raw NDJSON text (``value``) for every adapter observation, in the scan-record form:
    ``WWW.``-prefixed domains with a trailing dot, a legal-form org, vulns whose extra
    entries carry numeric *strings* (to be ignored), one key per technology and, on
    every 7th record, a detector key holding JSON null. ``sequence`` = event id."""
    o = obs_with_orgs
    q = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    domains = F.to_json(F.transform("registrable_domains", lambda d: F.concat(F.lit("WWW."), d, F.lit("."))))
    vulns = F.concat(F.lit("{"), F.array_join(F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("vuln_count") - 1, F.lit(0))),
        lambda i: F.when(F.col("vuln_count") > 0, F.concat(
            F.lit('"CVE-2024-'), F.col("event_id").cast("string"), F.lit("-"), i.cast("string"), F.lit('":'),
            F.when(i == 0, F.concat(F.lit('{"cvss":'), F.col("vuln_max_cvss").cast("string"), F.lit("}")))
             .otherwise(F.lit('{"cvss":"7.5"}'))))), ","), F.lit("}"))
    techs = F.array_join(F.transform("detected_technologies",
                                     lambda t: F.concat(F.lit('"'), t, F.lit('":{"version":"1"}'))), ",")
    parts = F.array(
        _kv("ip_str", q(F.col("ip_str"))),
        _kv("port", F.col("port").cast("string")),
        _kv("timestamp", q(F.col("timestamp"))),
        _kv("hostnames", F.to_json(F.array("hostname"))),
        _kv("domains", domains),
        _kv("org", q(F.col("org"))),
        _kv("location", F.to_json(F.struct("country_code"))),
        F.when(F.col("cloud_present"), _kv("cloud", F.to_json(F.struct(F.col("cloud_provider").alias("provider")),
                                                              {"ignoreNullFields": "false"}))),
        _kv("vulns", vulns),
        _kv("tags", F.when(F.col("has_eol_tag"), F.lit('["eol-product"]')).otherwise(F.lit("[]"))),
        F.when(F.size("detected_technologies") > 0, techs),
        F.when(F.col("event_id") % 7 == 0, F.lit('"telnet":null')),
    )
    return o.select(F.col("event_id").alias("sequence"),
                    F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("value"))
