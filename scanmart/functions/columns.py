"""Reusable column expressions. All are built-in Spark expressions (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanmart.functions import constants as K


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---------------------------------------------------------------- domains / services
def strip(c: str | Column) -> Column:
    """Without leading and trailing white space (tabs, line ends and Unicode spaces too)."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def normalize_domain(c: str | Column) -> Column:
    """casefold, strip white space of any kind and trailing dots, drop one leading ``www.``; empty -> null."""
    x = F.regexp_replace(strip(F.lower(_col(c))), r"\.+$", "")
    x = F.regexp_replace(x, r"^www\.", "")
    return F.nullif(x, F.lit(""))


def service_category(port: str | Column) -> Column:
    """Port -> category via a literal map lookup; unknown/null -> null."""
    m = F.create_map(*[item for kv in K.SERVICE_CATEGORIES.items() for item in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(m, _col(port).cast("int"))


def detected_services(techs: str | Column) -> Column:
    return F.array_sort(F.array_intersect(_col(techs), str_array(K.SERVICE_DETECTORS)))


def count_in(arr: str | Column, values) -> Column:
    return F.size(F.array_intersect(_col(arr), str_array(values)))


def clean_technologies(arr: str | Column) -> Column:
    """Drop deny-listed and ``_``-prefixed names (order kept)."""
    deny = str_array(K.NON_TECHNOLOGY_FIELDS)
    return F.filter(_col(arr), lambda x: ~F.array_contains(deny, x) & ~x.startswith("_"))


# ---------------------------------------------------------------- organisations
def normalize_org_ascii(c: str | Column, suffixes=K.ORG_LEGAL_SUFFIXES, two_word: bool = False) -> Column:
    """lower, trim, ``&``/``+`` runs -> `` and ``, non-word runs -> space, strip trailing
    legal suffixes while more than one word remains, empty -> null.

    ``(?U)`` makes ``\\w`` Unicode-aware. ``lower`` equals casefold for ASCII; non-ASCII
    names get NFKC+casefold first (``scanmart.operators.records.with_canonical_org``).
    """
    x = F.trim(F.lower(_col(c)))
    x = F.regexp_replace(x, r"[&+]+", " and ")
    x = F.trim(F.regexp_replace(x, r"(?U)[^\w]+", " "))
    singles = "|".join(s for s in suffixes if " " not in s)
    if two_word:
        doubles = "|".join(s for s in suffixes if " " in s)
        # two-word suffixes are stripped first (while > 1 word remains), then single words
        x = F.regexp_replace(x, rf"^(.+?)(( ({doubles}))+)$", "$1")
    # lazy head keeps at least one word; the tail takes every trailing suffix word
    x = F.regexp_replace(x, rf"^(.+?)(( ({singles}))+)$", "$1")
    return F.nullif(x, F.lit(""))


# ---------------------------------------------------------------- scoring pieces
def bounded(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 2)


def log_score(v: Column, midpoint: float) -> Column:
    """0 for v<=0, else round(clamp(100*ln(1+v)/ln(1+mid)), 2)."""
    v = F.coalesce(v, F.lit(0)).cast("double")
    return F.when(v <= 0, F.lit(0.0)).otherwise(
        bounded(F.lit(100.0) * F.log(F.lit(1.0) + v) / F.log(F.lit(1.0 + midpoint))))


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def icp_score(ips: Column, services: Column, technologies: Column, cloud: Column, countries: Column) -> Column:
    ips = F.coalesce(ips, F.lit(0))
    services = F.coalesce(services, F.lit(0))
    cloud = F.coalesce(cloud, F.lit(0))
    ntech = F.size(F.filter(F.coalesce(technologies, F.array().cast("array<string>")),
                            lambda t: ~t.startswith("_")))
    has_country = F.coalesce(F.size(countries) > 0, F.lit(False))
    score = (F.lit(40.0)
             + F.when((ips >= 3) & (ips <= 200), 20.0).when(ips > 200, 8.0).otherwise(0.0)
             + F.when(services >= 3, 15.0).otherwise(0.0)
             + F.when(ntech >= 2, 15.0).otherwise(0.0)
             + F.when(has_country, 10.0).otherwise(0.0)
             - F.when((cloud != 0) & (ips >= 10) & (services <= 2) & (ntech <= 1), 15.0).otherwise(0.0))
    return bounded(score)


def industry_override(score: Column, industry: Column, targets: tuple[str, ...]) -> Column:
    """100 for an account of a target industry, 25 for one of another; without an industry, or targets, ``score``."""
    if not targets:
        return score
    return F.when(industry.isNull() | (industry == ""), score).when(industry.isin(*targets), 100.0).otherwise(25.0)


def weighted_opportunity(icp: Column, exposure: Column, vulnerability: Column, technology: Column,
                         recency: Column) -> Column:
    parts = dict(icp=icp, exposure=exposure, vulnerability=vulnerability, technology=technology, recency=recency)
    total = F.lit(0.0)
    for name, w in K.WEIGHTS:
        total = total + F.lit(w) * F.coalesce(parts[name].cast("double"), F.lit(0.0))
    return total


# ---------------------------------------------------------------- JSON / VARIANT helpers
def json_truthy(v: Column) -> Column:
    """Python ``bool(x)`` of a JSON value held in a VARIANT: null, false, 0, "", [], {} are false.

    By the value's type: only numbers are compared with zero (the strings "0" and "0.0" are
    true), and objects and arrays are never written out as text."""
    s = F.schema_of_variant(v)
    empty = (s.isin("VOID", "ARRAY<>", "ARRAY<VOID>", "OBJECT<>")) & ~(F.coalesce(F.size(
        F.try_variant_get(v, "$", "array<variant>")), F.lit(0)) > 0)
    return F.coalesce(
        F.when(v.isNull() | empty, F.lit(False))
        .when(s == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(s == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(s.startswith("ARRAY") | s.startswith("OBJECT"), F.lit(True))
        .otherwise(F.try_variant_get(v, "$", "double") != 0), F.lit(False))


def json_type(v: Column) -> Column:
    """Seven-way JSON type name (bool tested before int)."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull() | (s == "VOID"), "null")
            .when(s == "BOOLEAN", "bool")
            .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
            .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
            .when(s.startswith("ARRAY"), "array")
            .when(s.startswith("OBJECT"), "object")
            .otherwise("string"))


def display_value(json_text: Column, limit: int = 120) -> Column:
    """Canonical JSON text truncated to ``limit`` chars (``limit-3`` + ``...``)."""
    return F.when(F.length(json_text) <= limit, json_text).otherwise(
        F.concat(F.substring(json_text, 1, limit - 3), F.lit("...")))
