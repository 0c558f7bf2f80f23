"""Raw scan record (VARIANT) -> 64-column curated observation, and the simple 17-column row.

Everything is a narrow projection of built-in VARIANT/array functions; the only
non-local input is the fixed public-suffix rule set (literal hash sets). Organisation names that
contain non-ASCII characters get NFKC + casefold through one Arrow-batched pandas UDF
(ASCII rows pass it a null).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmart.functions import columns as C
from scanmart.functions import constants as K
from scanmart.operators.observations import observation_id
from scanmart.sources import suffixes as PSL

OBSERVATION_COLUMNS = (
    "observation_id", "timestamp", "ip", "ip_str", "ipv6", "asn", "domain", "domains", "hostname", "hostnames",
    "registrable_domains", "country_code", "country_name", "region_code", "city", "latitude", "longitude", "port",
    "transport", "service_category", "product", "version", "os", "http_status", "http_title", "http_server",
    "http_host", "http_redirect_count", "http_securitytxt", "http_has_html", "ssl_present", "ssl_version",
    "ssl_cert_subject", "ssl_cert_issuer", "ssl_cert_expiry", "cloud_present", "cloud_provider", "cloud_region",
    "cloud_service", "org", "canonical_org", "isp", "tags", "tag_count", "has_eol_tag", "cpe", "cpe23", "cpe_count",
    "cpe23_count", "vuln_present", "vuln_count", "vuln_ids", "vuln_max_cvss", "vuln_has_known_exploit",
    "detected_technologies", "detected_services", "service_count", "sensitive_service_count",
    "remote_access_service_count", "database_service_count", "raw_tags_json", "raw_vulns_json", "raw_http_json",
    "raw_ssl_json",
)


# ------------------------------------------------------------------ VARIANT accessors
def vget(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


def vtype(x: Column) -> Column:
    return F.schema_of_variant(x)


def is_object(x: Column) -> Column:
    return F.coalesce(vtype(x).startswith("OBJECT"), F.lit(False))


def obj_field(v: Column, obj: str, key: str, typ: str = "string") -> Column:
    """``record[obj][key]`` only when ``record[obj]`` is an object (else null)."""
    return F.when(is_object(vget(v, f"$.{obj}")), vget(v, f"$.{obj}.{key}", typ))


def as_text(x: Column) -> Column:
    """Python ``str(value)`` approximation: strings as is, other JSON as compact JSON."""
    return F.when(x.isNull() | F.is_variant_null(x), F.lit(None)).when(
        vtype(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))


def truthy(x: Column) -> Column:
    return C.json_truthy(x)


def list_of(v: Column, path: str) -> Column:
    """array<variant> when the value is a list, else []."""
    return F.coalesce(vget(v, path, "array<variant>"), F.array().cast("array<variant>"))


def strings_of(v: Column, path: str) -> Column:
    """List elements that are strings (other element types -> null kept out)."""
    return F.transform(list_of(v, path), lambda x: F.when(vtype(x) == "STRING", F.try_variant_get(x, "$", "string")))


def numeric(x: Column) -> Column:
    """Python ``isinstance(x, (int, float))`` (bools included) as double, else null."""
    t = vtype(x)
    ok = t.isin("BOOLEAN", "BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    return F.when(ok, F.when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double"))
                  .otherwise(F.try_variant_get(x, "$", "double")))


def canonical_json(x: Column) -> Column:
    """Sorted-key compact JSON text; missing -> ``null``."""
    return F.coalesce(F.to_json(x), F.lit("null"))


# ------------------------------------------------------------------ record -> observation
def technologies(v: Column) -> Column:
    """Sorted top-level keys whose value is not JSON null, not deny-listed, not ``_*``."""
    m = vget(v, "$", "map<string,variant>")
    keep = F.map_filter(m, lambda k, x: ~F.is_variant_null(x) & ~F.array_contains(
        C.str_array(K.NON_TECHNOLOGY_FIELDS), k) & ~k.startswith("_"))
    return F.array_sort(F.coalesce(F.map_keys(keep), F.array().cast("array<string>")))


def records_to_observations(records: DataFrame, extra_rules=(), seq_col: str = "sequence",
                            v_col: str = "v", nfkc: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """64-column observation rows; ``extra_rules`` are added to the bundled suffix rules. The columns ``keep`` of the
    records (none named like an observation's) are handed on after them."""
    v = F.col(v_col)
    r = records
    sets = PSL.rule_sets(extra=extra_rules)
    domains = F.filter(F.transform(strings_of(v, "$.domains"), C.normalize_domain), lambda x: x.isNotNull())
    hostnames = F.filter(F.transform(strings_of(v, "$.hostnames"), C.normalize_domain), lambda x: x.isNotNull())
    vulns_m = F.when(is_object(vget(v, "$.vulns")), vget(v, "$.vulns", "map<string,variant>"))
    details = F.filter(F.coalesce(F.map_values(vulns_m), F.array().cast("array<variant>")), is_object)
    cvss = F.flatten(F.transform(details, lambda d: F.array(
        numeric(vget(d, "$.cvss")), numeric(vget(d, "$.cvss_v3")), numeric(vget(d, "$.cvss_v2")))))
    tags = F.transform(list_of(v, "$.tags"), lambda x: F.coalesce(as_text(x), F.lit("None")))
    http_redirects = vget(v, "$.http.redirects", "array<variant>")
    port_v = vget(v, "$.port")
    port = F.when(vtype(port_v).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), vget(v, "$.port", "int"))
    ssl_first = lambda a, b: F.coalesce(
        F.when(truthy(vget(v, f"$.ssl.{a}")), as_text(vget(v, f"$.ssl.{a}"))), as_text(vget(v, f"$.ssl.{b}")))
    ssl_obj = is_object(vget(v, "$.ssl"))

    base = r.select(
        "*",
        as_text(vget(v, "$.timestamp")).alias("timestamp"),
        vget(v, "$.ip_str", "string").alias("ip_str"),
        domains.alias("domains"),
        hostnames.alias("hostnames"),
        port.alias("port"),
        as_text(port_v).alias("_port_text"),
        technologies(v).alias("detected_technologies"),
        tags.alias("tags"),
        vulns_m.alias("_vulns"),
        details.alias("_details"),
        F.array_max(F.filter(cvss, lambda x: x.isNotNull())).alias("vuln_max_cvss"),
    )
    reg = F.array_sort(F.array_distinct(F.filter(PSL.registrable_domains_of("domains", sets),
                                                 lambda x: x.isNotNull())))
    out = base.select(
        observation_id(F.col(seq_col), F.col("ip_str"), F.col("timestamp"), F.col("_port_text")).alias("observation_id"),
        "timestamp",
        F.col("ip_str").alias("ip"),
        "ip_str",
        vget(v, "$.ipv6", "string").alias("ipv6"),
        as_text(vget(v, "$.asn")).alias("asn"),
        F.get("domains", 0).alias("domain"),
        "domains",
        F.get("hostnames", 0).alias("hostname"),
        "hostnames",
        reg.alias("registrable_domains"),
        obj_field(v, "location", "country_code").alias("country_code"),
        obj_field(v, "location", "country_name").alias("country_name"),
        obj_field(v, "location", "region_code").alias("region_code"),
        obj_field(v, "location", "city").alias("city"),
        obj_field(v, "location", "latitude", "double").alias("latitude"),
        obj_field(v, "location", "longitude", "double").alias("longitude"),
        "port",
        vget(v, "$.transport", "string").alias("transport"),
        C.service_category(F.col("port")).alias("service_category"),
        vget(v, "$.product", "string").alias("product"),
        vget(v, "$.version", "string").alias("version"),
        vget(v, "$.os", "string").alias("os"),
        obj_field(v, "http", "status", "int").alias("http_status"),
        obj_field(v, "http", "title").alias("http_title"),
        obj_field(v, "http", "server").alias("http_server"),
        obj_field(v, "http", "host").alias("http_host"),
        F.when(is_object(vget(v, "$.http")), F.coalesce(F.size(http_redirects), F.lit(0))).otherwise(0)
         .cast("int").alias("http_redirect_count"),
        (is_object(vget(v, "$.http")) & truthy(vget(v, "$.http.securitytxt"))).alias("http_securitytxt"),
        (is_object(vget(v, "$.http")) & truthy(vget(v, "$.http.html"))).alias("http_has_html"),
        truthy(vget(v, "$.ssl")).alias("ssl_present"),
        obj_field(v, "ssl", "version").alias("ssl_version"),
        F.when(ssl_obj, ssl_first("cert_subject", "subject")).alias("ssl_cert_subject"),
        F.when(ssl_obj, ssl_first("cert_issuer", "issuer")).alias("ssl_cert_issuer"),
        F.when(ssl_obj, ssl_first("cert_expiry", "expires")).alias("ssl_cert_expiry"),
        truthy(vget(v, "$.cloud")).alias("cloud_present"),
        obj_field(v, "cloud", "provider").alias("cloud_provider"),
        obj_field(v, "cloud", "region").alias("cloud_region"),
        obj_field(v, "cloud", "service").alias("cloud_service"),
        F.when(vtype(vget(v, "$.org")) == "STRING", vget(v, "$.org", "string")).alias("org"),
        vget(v, "$.isp", "string").alias("isp"),
        "tags",
        F.size("tags").alias("tag_count"),
        (F.array_contains("tags", "eol-product") | F.array_contains("tags", "eol-os")).alias("has_eol_tag"),
        F.transform(list_of(v, "$.cpe"), as_text).alias("cpe"),
        F.transform(list_of(v, "$.cpe23"), as_text).alias("cpe23"),
        F.size(list_of(v, "$.cpe")).alias("cpe_count"),
        F.size(list_of(v, "$.cpe23")).alias("cpe23_count"),
        F.coalesce(F.size("_vulns") > 0, F.lit(False)).alias("vuln_present"),
        F.coalesce(F.size("_vulns"), F.lit(0)).alias("vuln_count"),
        F.array_sort(F.coalesce(F.map_keys("_vulns"), F.array().cast("array<string>"))).alias("vuln_ids"),
        "vuln_max_cvss",
        F.exists("_details", lambda d: truthy(vget(d, "$.kev")) | truthy(vget(d, "$.verified")))
         .alias("vuln_has_known_exploit"),
        "detected_technologies",
        canonical_json(vget(v, "$.tags")).alias("raw_tags_json"),
        canonical_json(vget(v, "$.vulns")).alias("raw_vulns_json"),
        canonical_json(vget(v, "$.http")).alias("raw_http_json"),
        canonical_json(vget(v, "$.ssl")).alias("raw_ssl_json"),
        *keep,
    )
    from scanmart.operators.observations import with_service_columns

    out = with_service_columns(out)
    out = with_canonical_org(out, "org", "canonical_org", nfkc=nfkc)
    return out.select(*OBSERVATION_COLUMNS, *keep)


# ------------------------------------------------------------------ organisation names
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def nfkc_casefold(c: Column) -> Column:
    """Arrow-batched NFKC + casefold (created lazily: needs an active session)."""
    from pyspark.sql.types import StringType

    return F.pandas_udf(_nfkc_casefold, StringType())(c)


def with_canonical_org(df: DataFrame, src: str, dst: str, suffixes=K.ORG_LEGAL_SUFFIXES, two_word: bool = False,
                       nfkc: bool = True) -> DataFrame:
    """``dst`` = normalized organisation of ``src``.

    ASCII names stay on the JVM (``lower`` equals casefold there). Names with any
    non-ASCII character are NFKC+casefolded by an Arrow-batched pandas UDF in the same
    stage: the UDF input is null for ASCII rows, so only non-ASCII names cross into
    Python, and no shuffle or join is needed (a hot organisation costs nothing extra).
    ``nfkc=False`` keeps everything on the JVM (``lower`` only).
    """
    if not nfkc:
        return df.withColumn(dst, C.normalize_org_ascii(F.col(src), suffixes, two_word))
    non_ascii = F.col(src).isNotNull() & ~F.col(src).rlike(r"^[\x00-\x7F]*$")
    folded = nfkc_casefold(F.when(non_ascii, F.col(src)))
    text = F.when(non_ascii, folded).otherwise(F.col(src))
    return df.withColumn(dst, C.normalize_org_ascii(text, suffixes, two_word))


# ------------------------------------------------------------------ simple 17-column row
def simple_observations(records: DataFrame, extra_rules=(), v_col: str = "v") -> DataFrame:
    """The reference's simple parse: nested values kept as JSON text."""
    v = F.col(v_col)
    r = records
    sets = PSL.rule_sets(extra=extra_rules)
    domains = F.filter(F.transform(strings_of(v, "$.domains"), C.normalize_domain), lambda x: x.isNotNull())
    hostnames = F.filter(F.transform(strings_of(v, "$.hostnames"), C.normalize_domain), lambda x: x.isNotNull())
    port = F.when(vtype(vget(v, "$.port")).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), vget(v, "$.port", "int"))
    out = r.select(v, domains.alias("domains")).select(
        vget(v, "$.ip_str", "string").alias("ip"),
        "domains",
        hostnames.alias("hostnames"),
        F.array_sort(F.array_distinct(F.filter(PSL.registrable_domains_of("domains", sets),
                                               lambda x: x.isNotNull()))).alias("registrable_domains"),
        C.service_category(port).alias("service_category"),
        F.when(vtype(vget(v, "$.org")) == "STRING", vget(v, "$.org", "string")).alias("raw_org"),
        port.alias("port"),
        vget(v, "$.product", "string").alias("product"),
        vget(v, "$.version", "string").alias("version"),
        F.coalesce(F.to_json(vget(v, "$.tags")), F.lit("[]")).alias("tags"),
        F.coalesce(F.to_json(vget(v, "$.vulns")), F.lit("{}")).alias("vulns"),
        F.coalesce(F.to_json(vget(v, "$.cpe")), F.lit("[]")).alias("cpe"),
        canonical_json(vget(v, "$.cloud")).alias("cloud"),
        as_text(vget(v, "$.timestamp")).alias("timestamp"),
        canonical_json(vget(v, "$.location")).alias("location"),
        as_text(vget(v, "$.asn")).alias("asn"),
    )
    return with_canonical_org(out, "raw_org", "canonical_org")


def signal_counts(simple: DataFrame) -> DataFrame:
    """0/1 flags per simple row: exposure (port), vulnerability (non-empty vulns),
    technology (product or non-empty cpe). Empty JSON text counts as empty."""
    empty = ("{}", "[]", "null", '""')
    return simple.select(
        "*",
        F.coalesce((F.col("port").isNotNull() & (F.col("port") != 0)), F.lit(False)).cast("double").alias("exposure"),
        (~F.col("vulns").isin(*empty)).cast("double").alias("vulnerability"),
        (F.coalesce(F.length("product") > 0, F.lit(False)) | ~F.col("cpe").isin(*empty)).cast("double")
        .alias("technology"),
    )
