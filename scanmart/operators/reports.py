"""Profiling report sets from one pass over the records.

Each record is taken apart once into (report, key, value) rows for all parts of a report set, which
are counted in one aggregation, combined map-side. That table is written; every part of the set is
read off it and is small. The single operators are in :mod:`scanmart.operators.profiling`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmart.functions import columns as C
from scanmart.functions import constants as K
from scanmart.operators import profiling as P
from scanmart.operators.records import as_text, canonical_json, is_object, truthy, vget, vtype
from scanmart.session import shared_path

_ROWS = "array<struct<report:string,key:string,value:string>>"


def _row(report: str, key, value="") -> Column:
    text = lambda x: (F.lit(x) if isinstance(x, str) else x).cast("string")
    return F.struct(F.lit(report).alias("report"), text(key).alias("key"), text(value).alias("value"))


def _if(condition: Column, *rows: Column) -> Column:
    return F.when(condition, F.array(*rows)).otherwise(F.array().cast(_ROWS))


def _each(values: Column, row) -> Column:
    return F.coalesce(F.transform(values, row), F.array().cast(_ROWS))


def _map(v: Column) -> Column:
    return vget(v, "$", "map<string,variant>")


def _apart(rows: DataFrame) -> DataFrame:
    """(report, key, value) of the rows' facts.

    For an inner explode of a column Spark infers a filter on its size and pushes that, with all that makes the
    facts, below every projection and exchange: each record would be parsed and taken apart twice, first where the
    lines are made. An outer one has no such filter."""
    return rows.select(F.explode_outer("facts").alias("x")).where("x IS NOT NULL").select("x.*")


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """(report, key, value, records) of the rows' facts, written to the shared folder and read again."""
    counts = _apart(rows).groupBy("report", "key", "value").agg(F.count(F.lit(1)).alias("records"))
    path = shared_path(rows.sparkSession, f"{name}-{uuid.uuid4().hex}")
    counts.write.parquet(path)
    return rows.sparkSession.read.schema(counts.schema).parquet(path)


def _part(counts: DataFrame, report: str, key: str, value: str | None = None) -> DataFrame:
    rows = counts.where(F.col("report") == report)
    return rows.select(F.col("key").alias(key), *([F.col("value").alias(value)] if value else []), "records")


def _total(counts: DataFrame, report: str, key: str) -> Column:
    return F.coalesce(F.sum(F.when((F.col("report") == report) & (F.col("key") == key), F.col("records"))), F.lit(0)).cast("bigint")


# ------------------------------------------------------------------ field profile (presence, types, values, organisations)
def profile_facts(v: Column, fields=K.IMPORTANT_FIELDS) -> Column:
    listed = F.map_entries(F.map_filter(_map(v), lambda k, _: k.isin(*fields)))
    org = vget(v, "$.org")
    alias = _row("org", F.when(vtype(org) == "STRING", P.canonical_profile_org(vget(v, "$.org", "string"))), C.display_value(canonical_json(org)))
    return F.concat(
        F.array(_row("all", "records")),
        _each(listed, lambda e: _row("type", e["key"], C.json_type(e["value"]))),
        _each(listed, lambda e: _row("value", e["key"], C.display_value(canonical_json(e["value"])))),
        _if(F.coalesce(F.array_contains(F.map_keys(_map(v)), "org"), F.lit(False)), alias))


def profile_report(records: DataFrame, top_values: int = 10, fields=K.IMPORTANT_FIELDS, v_col: str = "v") -> dict[str, DataFrame]:
    """Field presence, types and most common values, organisation names and their aliases."""
    counts = _counted(records.select(profile_facts(F.col(v_col), fields).alias("facts")), "profile")
    types = _part(counts, "type", "field", "value_type")
    total = counts.agg(_total(counts, "all", "records").alias("records"))
    present = types.groupBy("field").agg(F.sum("records").alias("present"))
    names = total.select("records", F.explode(C.str_array(fields)).alias("field")).join(present, "field", "left")
    aliases = _part(counts, "org", "canonical", "alias")
    return {
        "totals": total,
        "field_presence": names.select("field", F.coalesce("present", F.lit(0)).alias("present"),
                                       (F.col("records") - F.coalesce("present", F.lit(0))).alias("missing")),
        "field_types": types,
        "top_values": P._top(_part(counts, "value", "field", "value"), "field", "value", "records", top_values),
        "organization_canonicalization": P.org_canonicalization(aliases),
        "top_canonical": P.top_canonical(aliases, top_values),
        "aliases": P.alias_lists(aliases, top_values),
    }


# ------------------------------------------------------------------ nested fields
def nested_facts(records: DataFrame, order: str, candidates=K.TECH_DETECTOR_CANDIDATES, nested=K.NESTED_FIELDS, v_col: str = "v") -> DataFrame:
    """(facts) of each record. Values that several facts need are columns first: the expressions stay small enough to compile."""
    v = F.col(v_col)
    m = _map(v)
    listed = lambda path: F.coalesce(vget(v, path, "array<variant>"), F.array().cast("array<variant>"))
    names = lambda path: F.transform(listed(path), lambda x: F.regexp_replace(
        F.lower(F.coalesce(as_text(x), F.lit("None"))), r"\.+$", ""))
    known = C.str_array(sorted(set(candidates)))
    base = records.select(
        F.col(order).alias("order"), vget(v, "$.vulns").alias("vulns"), vget(v, "$.org").alias("org"), vget(v, "$.product").alias("product"),
        F.map_values(vget(v, "$.vulns", "map<string,variant>")).alias("details"),
        F.array_sort(F.map_keys(F.map_filter(m, lambda k, x: F.array_contains(known, k) & ~F.is_variant_null(x)))).alias("detected"),
        names("$.domains").alias("domains"), names("$.hostnames").alias("hostnames"), as_text(vget(v, "$.port")).alias("port"),
        F.filter(F.transform(listed("$.tags"), as_text), lambda x: x.isNotNull()).alias("tags"),
        F.map_entries(F.map_filter(m, lambda k, x: k.isin(*nested) & ~F.is_variant_null(x))).alias("fields"))
    base = base.select(
        "*", truthy(F.col("vulns")).alias("vulnerable"), is_object(F.col("vulns")).alias("listing"), C.json_type(F.col("vulns")).alias("vulns_type"),
        F.when(truthy(F.col("org")), as_text(F.col("org"))).alias("org_text"), F.when(truthy(F.col("product")), as_text(F.col("product"))).alias("product_text"),
        F.transform("details", lambda x: F.struct(x.alias("x"), F.coalesce(
            F.map_keys(vget(x, "$", "map<string,variant>")), F.array().cast("array<string>")).alias("keys"), is_object(x).alias("object"),
            C.json_type(x).alias("type"), F.lower(F.to_json(x)).contains("kev").alias("kev"))).alias("found"),
        F.transform("fields", lambda e: F.struct(e["key"].alias("name"), C.json_type(e["value"]).alias("type"), F.when(is_object(e["value"]), F.map_keys(
            vget(e["value"], "$", "map<string,variant>"))).alias("keys"))).alias("nested"))
    detected, domains, hostnames = F.col("detected"), F.col("domains"), F.col("hostnames")
    pairs = F.flatten(F.transform(detected, lambda a, i: F.transform(
        F.slice(detected, i + 2, F.greatest(F.size(detected) - i - 1, F.lit(0))), lambda b: F.concat(a, F.lit("+"), b))))
    pointers = "|".join(p.replace("(?i)", "") for p in K.CLOUD_PTR_PATTERNS)
    has = lambda x, some: F.exists(x["keys"], lambda k: k.isin(*some))

    def detail(x):
        flagged = has(x, ("verified", "kev", "exploit", "exploited")) | x["kev"]
        return F.concat(F.array(_row("vulns", "cve_details_seen"), _row("vuln_type", x["type"])), _if(x["object"], _row("vulns", "object_details")),
                        _if(x["object"] & has(x, ("cvss", "cvss_v3", "cvss_v2")), _row("vulns", "records_with_cvss")),
                        _if(x["object"] & flagged, _row("vulns", "records_with_exploit_or_kev_flag")), F.transform(x["keys"], lambda k: _row("vuln_key", k)))

    given = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    parts = (
        F.array(_row("all", "records"), _row("length", "domains", F.size(domains)), _row("length", "hostnames", F.size(hostnames)),
                _row("identity", F.when(F.size(domains) > 0, "records_with_domains").otherwise("records_without_domains"))),
        _if(F.size(hostnames) > 0, _row("identity", "records_with_hostnames")),
        _if(F.exists(F.concat(domains, hostnames), lambda x: x.rlike(f"(?i){pointers}")), _row("identity", "cloud_ptr_pattern_records")),
        _if((F.size(domains) == 1) & (F.get(domains, F.lit(0)) == "googleusercontent.com"), _row("identity", "exact_googleusercontent_domain_records")),
        _if(F.col("vulnerable"), _row("vulns", "records_with_vulns")),
        _if(F.col("vulnerable") & ~F.col("listing"), _row("vuln_type", F.col("vulns_type"))),
        F.coalesce(F.flatten(F.transform("found", detail)), F.array().cast(_ROWS)),
        _each(domains, lambda x: _row("domain", x)), _each(F.col("tags"), lambda x: _row("tag", x)),
        _each(detected, lambda x: _row("technology", x)), _each(pairs, lambda x: _row("pair", x)),
        _if(F.coalesce(F.size(detected) > 1, F.lit(False)), _row("example", F.to_json(F.struct("order")), F.to_json(detected))),
        _if(given("port"), _row("port", F.col("port"))), _if(given("org_text"), _row("org", F.col("org_text"))),
        _if(given("product_text"), _row("product", F.col("product_text"))),
        _each(F.col("nested"), lambda e: _row("nested", e["name"], "<present>")),
        _each(F.col("nested"), lambda e: _row("nested", e["name"], F.concat(F.lit("<type:"), e["type"], F.lit(">")))),
        F.coalesce(F.flatten(F.transform("nested", lambda e: F.transform(
            F.coalesce(e["keys"], F.array().cast("array<string>")), lambda k: _row("nested_key", e["name"], k)))), F.array().cast(_ROWS)))
    base = base.select(*(x.alias(f"f{i}") for i, x in enumerate(parts)))
    return base.select(F.concat(*(F.col(c) for c in base.columns)).alias("facts"))


IDENTITY = ("records_with_domains", "records_without_domains", "records_with_hostnames", "cloud_ptr_pattern_records",
            "exact_googleusercontent_domain_records")
VULNS = ("records_with_vulns", "cve_details_seen", "object_details", "records_with_cvss", "records_with_exploit_or_kev_flag")


def nested_report(records: DataFrame, order: str = "sequence", v_col: str = "v") -> dict[str, DataFrame]:
    """Vulnerability details, lists, identities, technologies, most common values and nested structures."""
    order_type = records.schema[order].dataType.simpleString()
    counts = _counted(nested_facts(records, order, v_col=v_col), "nested")
    top = lambda report, name, k: P._top(_part(counts, report, name), None, name, "records", k)
    lengths = counts.where("report = 'length'").select(F.col("key").alias("list"), F.col("value").cast("int").alias("length"), "records")
    technologies = _part(counts, "technology", "technology")
    examples = counts.where("report = 'example'").select(
        F.from_json("key", f"order {order_type}")["order"].alias(order), F.from_json("value", "array<string>").alias("technologies"))
    nested = counts.where("report = 'nested'").select(F.col("key").alias("field"), F.col("value").alias("key"), "records")
    nested_keys = counts.where("report = 'nested_key'").select(F.col("key").alias("field"), F.col("value").alias("key"), "records")
    longest = lambda name: F.coalesce(F.max(F.when(F.col("list") == name, F.col("length"))), F.lit(0))
    coverage = F.round(_total(counts, "identity", "records_with_domains") / _total(counts, "all", "records"), 6)
    return {
        "totals": counts.agg(_total(counts, "all", "records").alias("records")),
        "vulns": counts.agg(*(_total(counts, "vulns", x).alias(x) for x in VULNS)),
        "vuln_detail_keys": top("vuln_key", "key", 30),
        "domains_hostnames": lengths,
        "identity_resolution": counts.agg(*(_total(counts, "identity", x).alias(x) for x in IDENTITY), coverage.alias("estimated_domain_coverage")),
        "top_domains": top("domain", "domain", 30),
        "tags_top100": top("tag", "tag", 100),
        "technologies": technologies,
        "technology_pairs": top("pair", "pair", 50),
        "technologies_above_100": technologies.where("records > 100").withColumn("candidate_count", F.lit(len(K.TECH_DETECTOR_CANDIDATES))),
        "technology_examples": examples.orderBy(order).limit(20),
        "vuln_value_types": _part(counts, "vuln_type", "value_type"),
        "list_maxima": lengths.agg(longest("domains").alias("max_domains"), longest("hostnames").alias("max_hostnames")),
        "ports": top("port", "port", 100),
        "organizations": top("org", "org", 100),
        "products": top("product", "product", 100),
        "nested_fields": nested.unionByName(P._top(nested_keys, "field", "key", "records", 50).drop("rank")),
    }


# ------------------------------------------------------------------ schema discovery and line quality
def schema_report(lines: DataFrame) -> dict[str, DataFrame]:
    """Every key with its types, and the lines, records and invalid lines; each line is parsed once, tolerantly."""
    rows = lines.select(F.try_parse_json("line").alias("v"))
    v = F.col("v")
    facts = F.when(is_object(v), F.concat(F.array(_row("line", "record")), _each(F.map_entries(_map(v)), lambda e: _row(
        "type", e["key"], C.json_type(e["value"]))))).otherwise(F.array(_row("line", "invalid")))
    counts = _counted(rows.select(facts.alias("facts")), "schema")
    records, invalid = _total(counts, "line", "record"), _total(counts, "line", "invalid")
    return {"keys": _part(counts, "type", "key", "value_type"),
            "lines": counts.agg((records + invalid).alias("lines"), records.alias("records"), invalid.alias("invalid_lines"))}


def as_table(reports: dict[str, DataFrame]) -> DataFrame:
    """A report set as one table: (report, label, measure, amount), a row for each number of each report's rows.

    The label is made of the row's texts and lists, in the order of their columns' names."""
    out = None
    for name, df in reports.items():
        kinds = {f.name: f.dataType.typeName() for f in df.schema}
        texts = [F.array_join(c, ",") if kinds[c] == "array" else F.col(c) for c in sorted(kinds) if kinds[c] in ("string", "array")]
        numbers = [c for c in sorted(kinds) if kinds[c] not in ("string", "array")]
        rows = df.select(F.lit(name).alias("report"), F.concat_ws(" | ", *texts).alias("label"), F.explode(F.array(*(
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("amount")) for c in numbers))).alias("x")).select("report", "label", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out
