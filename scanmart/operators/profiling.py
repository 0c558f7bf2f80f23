"""Dataset profiling over raw records held as VARIANT (column ``v``).

Every report is a long-format DataFrame computed with exact shuffle aggregates
(map-side combined); top-k lists use a deterministic tie-break (count desc, value asc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from scanmart.operators.scalars import attach

from scanmart.functions import columns as C
from scanmart.functions import constants as K
from scanmart.operators.records import as_text, canonical_json, is_object, truthy, vget, vtype


def _top(df: DataFrame, group: str | None, value: str, count: str, k: int) -> DataFrame:
    order = [F.desc(count), F.asc(value)]
    w = Window.partitionBy(group).orderBy(*order) if group else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def entries(records: DataFrame, v_col: str = "v") -> DataFrame:
    """(key, value) per top-level key of each object record (null-valued keys kept)."""
    m = vget(F.col(v_col), "$", "map<string,variant>")
    return records.select(F.explode(m).alias("key", "value"))


def field_presence(records: DataFrame, fields=K.IMPORTANT_FIELDS, v_col: str = "v") -> DataFrame:
    """Per fixed field: records where the key exists, and records where it does not."""
    total = records.agg(F.count(F.lit(1)).alias("records"))
    present = (entries(records, v_col).filter(F.col("key").isin(*fields))
               .groupBy("key").agg(F.count(F.lit(1)).alias("present")))
    names = total.select(F.explode(C.str_array(fields)).alias("field"), "records")
    return (names.join(present, names.field == present.key, "left")
            .select("field", F.coalesce("present", F.lit(0)).alias("present"),
                    (F.col("records") - F.coalesce("present", F.lit(0))).alias("missing")))


def field_types(records: DataFrame, fields=K.IMPORTANT_FIELDS, v_col: str = "v") -> DataFrame:
    """(field, value_type, records) for the fixed fields (JSON type names, bool before int)."""
    e = entries(records, v_col).filter(F.col("key").isin(*fields))
    return (e.groupBy(F.col("key").alias("field"), C.json_type(F.col("value")).alias("value_type"))
            .agg(F.count(F.lit(1)).alias("records")))


def schema_discovery(records: DataFrame, v_col: str = "v") -> DataFrame:
    """(key, value_type, records) over every key found in the data."""
    e = entries(records, v_col)
    return (e.groupBy("key", C.json_type(F.col("value")).alias("value_type"))
            .agg(F.count(F.lit(1)).alias("records")))


def value_top(records: DataFrame, fields=K.IMPORTANT_FIELDS, k: int = 10, v_col: str = "v") -> DataFrame:
    """Exact most common display values per field (canonical JSON, 120-char display)."""
    e = entries(records, v_col).filter(F.col("key").isin(*fields))
    counts = (e.groupBy(F.col("key").alias("field"), C.display_value(canonical_json(F.col("value"))).alias("value"))
              .agg(F.count(F.lit(1)).alias("records")))
    return _top(counts, "field", "value", "records", k)


def canonical_profile_org(c: Column) -> Column:
    """The profiling canonical org: two-word ``ag co`` first, long legal forms included."""
    return C.normalize_org_ascii(c, K.PROFILE_LEGAL_SUFFIXES, two_word=True)


def org_aliases(records: DataFrame, v_col: str = "v") -> DataFrame:
    """(canonical, alias display value, records) for records that carry ``org``."""
    v = F.col(v_col)
    org_v = vget(v, "$.org")
    has = F.array_contains(F.map_keys(vget(v, "$", "map<string,variant>")), "org")
    # the condition comes out of a generator: a filter on it would be evaluated below the exchange, where lines are made
    rows = records.select(F.explode(F.array(F.struct(
        has.alias("has"), C.display_value(canonical_json(org_v)).alias("alias"),
        F.when(vtype(org_v) == "STRING", canonical_profile_org(vget(v, "$.org", "string"))).alias("canonical")))).alias("x")).select("x.*").where("has")
    return rows.groupBy("canonical", "alias").agg(F.count(F.lit(1)).alias("records"))


def org_canonicalization(aliases: DataFrame) -> DataFrame:
    """raw_unique, canonical_unique, merged_records (records of canonicals with >1 alias)."""
    per_c = (aliases.filter(F.col("canonical").isNotNull()).groupBy("canonical")
             .agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("aliases")))
    raw = aliases.agg(F.countDistinct("alias").alias("raw_unique"))
    can = per_c.agg(F.count(F.lit(1)).alias("canonical_unique"),
                    F.coalesce(F.sum(F.when(F.col("aliases") > 1, F.col("records"))), F.lit(0))
                    .cast("bigint").alias("merged_records"))
    return attach(raw, can)


def top_canonical(aliases: DataFrame, k: int = 10) -> DataFrame:
    """Top canonical orgs with record and alias counts."""
    per_c = (aliases.filter(F.col("canonical").isNotNull()).groupBy("canonical")
             .agg(F.sum("records").cast("bigint").alias("records"), F.count(F.lit(1)).alias("aliases")))
    return _top(per_c, None, "canonical", "records", k)


def counts_top(records: DataFrame, expr: Column, name: str, k: int = 100) -> DataFrame:
    """Most common values of one expression (nulls/empty dropped).

    The expression is evaluated in a generator: a filter on it would be compiled with copies of it."""
    c = (records.select(F.explode(F.array(expr)).alias(name)).filter(F.col(name).isNotNull() & (F.col(name) != ""))
         .groupBy(name).agg(F.count(F.lit(1)).alias("records")))
    return _top(c, None, name, "records", k)


def port_top(records: DataFrame, k: int = 100, v_col: str = "v") -> DataFrame:
    return counts_top(records, as_text(vget(F.col(v_col), "$.port")), "port", k)


def org_top(records: DataFrame, k: int = 100, v_col: str = "v") -> DataFrame:
    org = vget(F.col(v_col), "$.org")
    return counts_top(records, F.when(truthy(org), as_text(org)), "org", k)


def tag_top(records: DataFrame, k: int = 100, v_col: str = "v") -> DataFrame:
    tags = F.coalesce(vget(F.col(v_col), "$.tags", "array<variant>"), F.array().cast("array<variant>"))
    c = (records.select(F.explode(tags).alias("t")).select(as_text(F.col("t")).alias("tag"))
         .filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("records")))
    return _top(c, None, "tag", "records", k)


def list_lengths(records: DataFrame, v_col: str = "v") -> DataFrame:
    """(list, length, records) distribution of ``domains`` and ``hostnames`` lengths."""
    v = F.col(v_col)
    lens = records.select(F.explode(F.array(
        F.struct(F.lit("domains").alias("list"),
                 F.coalesce(F.size(vget(v, "$.domains", "array<variant>")), F.lit(0)).alias("length")),
        F.struct(F.lit("hostnames").alias("list"),
                 F.coalesce(F.size(vget(v, "$.hostnames", "array<variant>")), F.lit(0)).alias("length")))).alias("s"))
    return lens.groupBy("s.list", "s.length").agg(F.count(F.lit(1)).alias("records"))


def identity_profile(records: DataFrame, v_col: str = "v") -> DataFrame:
    """Domain coverage, cloud reverse-DNS patterns, exact ``googleusercontent.com``."""
    v = F.col(v_col)

    def norm(path):
        arr = F.coalesce(vget(v, path, "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(arr, lambda x: F.regexp_replace(F.lower(F.coalesce(as_text(x), F.lit("None"))), r"\.+$", ""))
    r = records.select(norm("$.domains").alias("d"), norm("$.hostnames").alias("h"))
    ptr = "|".join(p.replace("(?i)", "") for p in K.CLOUD_PTR_PATTERNS)
    ids = F.concat("d", "h")
    return r.agg(
        F.count_if(F.size("d") > 0).alias("records_with_domains"),
        F.count_if(F.size("d") == 0).alias("records_without_domains"),
        F.count_if(F.size("h") > 0).alias("records_with_hostnames"),
        F.round(F.count_if(F.size("d") > 0) / F.count(F.lit(1)), 6).alias("estimated_domain_coverage"),
        F.count_if(F.exists(ids, lambda x: x.rlike(f"(?i){ptr}"))).alias("cloud_ptr_pattern_records"),
        F.count_if((F.size("d") == 1) & (F.get("d", 0) == "googleusercontent.com"))
         .alias("exact_googleusercontent_domain_records"),
    )


def domain_top(records: DataFrame, k: int = 30, v_col: str = "v") -> DataFrame:
    arr = F.coalesce(vget(F.col(v_col), "$.domains", "array<variant>"), F.array().cast("array<variant>"))
    c = (records.select(F.explode(arr).alias("x"))
         .select(F.regexp_replace(F.lower(F.coalesce(as_text(F.col("x")), F.lit("None"))), r"\.+$", "").alias("domain"))
         .groupBy("domain").agg(F.count(F.lit(1)).alias("records")))
    return _top(c, None, "domain", "records", k)


def technology_presence(records: DataFrame, v_col: str = "v") -> DataFrame:
    """Records per candidate detector key holding a non-null value."""
    cands = sorted(set(K.TECH_DETECTOR_CANDIDATES))
    m = vget(F.col(v_col), "$", "map<string,variant>")
    det = F.array_sort(F.map_keys(F.map_filter(m, lambda k, x: F.array_contains(C.str_array(cands), k)
                                               & ~F.is_variant_null(x))))
    c = records.select(F.explode(det).alias("technology")).groupBy("technology").agg(
        F.count(F.lit(1)).alias("records"))
    return c


def technology_cooccurrence(records: DataFrame, k: int = 50, v_col: str = "v") -> DataFrame:
    """Pairs of candidate detectors seen in the same record (``left+right``), top ``k``.

    Pairs are formed inside one record's detected list, which is bounded by the
    candidate list; they are counted with a map-side combined aggregate."""
    cands = sorted(set(K.TECH_DETECTOR_CANDIDATES))
    m = vget(F.col(v_col), "$", "map<string,variant>")
    det = F.array_sort(F.map_keys(F.map_filter(m, lambda k2, x: F.array_contains(C.str_array(cands), k2)
                                               & ~F.is_variant_null(x))))
    pairs = F.flatten(F.transform(det, lambda a, i: F.transform(
        F.slice(det, i + 2, F.greatest(F.size(det) - i - 1, F.lit(0))), lambda b: F.concat(a, F.lit("+"), b))))
    c = (records.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("records")))
    return _top(c, None, "pair", "records", k)


def vuln_profile(records: DataFrame, v_col: str = "v") -> DataFrame:
    """Records with (truthy) vulns, CVE details seen, details that are objects, details
    carrying a CVSS key, details carrying an exploit/KEV flag."""
    v = F.col(v_col)
    # only an object has details, and an empty one has none: no filter on the value's truth is
    # needed (Spark does not compile one over several variant reads, and would run it interpreted)
    details = records.select(F.explode(F.map_values(vget(v, "$.vulns", "map<string,variant>"))).alias("d"))
    dkeys = F.coalesce(F.map_keys(vget(F.col("d"), "$", "map<string,variant>")), F.array().cast("array<string>"))
    has_any = lambda names: F.exists(dkeys, lambda x: x.isin(*names))
    return attach(details.agg(
        F.count(F.lit(1)).alias("cve_details_seen"),
        F.count_if(is_object(F.col("d"))).alias("object_details"),
        F.count_if(is_object(F.col("d")) & has_any(("cvss", "cvss_v3", "cvss_v2"))).alias("records_with_cvss"),
        F.count_if(is_object(F.col("d")) & (has_any(("verified", "kev", "exploit", "exploited"))
                                             | F.lower(F.to_json(F.col("d"))).contains("kev")))
         .alias("records_with_exploit_or_kev_flag"),
    ), records.agg(F.count_if(truthy(vget(v, "$.vulns"))).alias("records_with_vulns")))


def vuln_detail_keys(records: DataFrame, k: int = 30, v_col: str = "v") -> DataFrame:
    m = vget(F.col(v_col), "$.vulns", "map<string,variant>")
    d = records.select(F.explode(F.map_values(m)).alias("d"))
    keys = d.select(F.explode(vget(F.col("d"), "$", "map<string,variant>")).alias("key", "_v"))
    return _top(keys.groupBy("key").agg(F.count(F.lit(1)).alias("records")), None, "key", "records", k)


def nested_structure(records: DataFrame, fields=K.NESTED_FIELDS, k: int = 50, v_col: str = "v") -> DataFrame:
    """(field, key, records) top keys of each nested object field, plus presence and
    type counts as (field, '<type:...>' / '<present>') rows."""
    v = F.col(v_col)
    m = vget(v, "$", "map<string,variant>")
    e = records.select(F.explode(F.map_filter(m, lambda k2, x: k2.isin(*fields) & ~F.is_variant_null(x)))
                       .alias("field", "value"))
    types = e.groupBy("field", F.concat(F.lit("<type:"), C.json_type(F.col("value")), F.lit(">")).alias("key")) \
             .agg(F.count(F.lit(1)).alias("records"))
    keys = (e.filter(is_object(F.col("value")))
            .select("field", F.explode(F.map_keys(vget(F.col("value"), "$", "map<string,variant>"))).alias("key"))
            .groupBy("field", "key").agg(F.count(F.lit(1)).alias("records")))
    keys = _top(keys, "field", "key", "records", k).drop("rank")
    present = e.groupBy("field").agg(F.count(F.lit(1)).alias("records")).select("field", F.lit("<present>").alias("key"), "records")
    return present.unionByName(types).unionByName(keys)


def vuln_value_types(records: DataFrame, v_col: str = "v") -> DataFrame:
    """(value_type, records): the types of CVE details, and of ``vulns`` values that are no object."""
    vulns = vget(F.col(v_col), "$.vulns")
    counts = lambda df, n: df.groupBy("value_type").agg(n.alias("records"))
    details = records.select(F.explode(F.map_values(vget(F.col(v_col), "$.vulns", "map<string,variant>"))).alias("x"))
    inner = counts(details.select(C.json_type(F.col("x")).alias("value_type")), F.count(F.lit(1)))
    other = records.select(C.json_type(vulns).alias("value_type"), (truthy(vulns) & ~is_object(vulns)).alias("some"))
    outer = counts(other, F.count_if("some")).filter(F.col("records") > 0)
    return inner.unionByName(outer).groupBy("value_type").agg(F.sum("records").alias("records"))


def list_maxima(records: DataFrame, v_col: str = "v") -> DataFrame:
    """Largest number of domains and of hostnames in a record (no records: 0)."""
    size = lambda path: F.coalesce(F.size(vget(F.col(v_col), path, "array<variant>")), F.lit(0))
    return records.agg(F.coalesce(F.max(size("$.domains")), F.lit(0)).alias("max_domains"),
                       F.coalesce(F.max(size("$.hostnames")), F.lit(0)).alias("max_hostnames"))


def technologies_above(records: DataFrame, least: int = 100, v_col: str = "v") -> DataFrame:
    """Candidate detectors seen in more than ``least`` records, with the number of candidates."""
    return technology_presence(records, v_col).filter(F.col("records") > least).withColumn(
        "candidate_count", F.lit(len(K.TECH_DETECTOR_CANDIDATES)))


def technology_examples(records: DataFrame, k: int = 20, order: str = "sequence", v_col: str = "v") -> DataFrame:
    """The first ``k`` records with more than one candidate detector."""
    m = vget(F.col(v_col), "$", "map<string,variant>")
    cands = C.str_array(sorted(set(K.TECH_DETECTOR_CANDIDATES)))
    det = F.array_sort(F.map_keys(F.map_filter(m, lambda k2, x: F.array_contains(cands, k2) & ~F.is_variant_null(x))))
    return records.select(order, det.alias("technologies")).filter(F.size("technologies") > 1).orderBy(order).limit(k)


def product_top(records: DataFrame, k: int = 100, v_col: str = "v") -> DataFrame:
    product = vget(F.col(v_col), "$.product")
    return counts_top(records, F.when(truthy(product), as_text(product)), "product", k)


def alias_lists(aliases: DataFrame, k: int = 10) -> DataFrame:
    """(canonical, alias, records, rank): every alias of the ``k`` largest organisations, most common first.

    One row per alias: an organisation's aliases have no bound."""
    top = top_canonical(aliases, k).select("canonical")
    w = Window.partitionBy("canonical").orderBy(F.desc("records"), "alias")
    return aliases.join(top, "canonical", "left_semi").withColumn("rank", F.row_number().over(w))


def first_samples(records: DataFrame, n: int = 3, order: str = "sequence", v_col: str = "v") -> DataFrame:
    """The first ``n`` records as canonical JSON."""
    return records.orderBy(order).limit(n).select(order, canonical_json(F.col(v_col)).alias("record"))


def sample_fixed(lines: DataFrame, k: int = 8000, seed: int = 42, key_cols=("file", "line")) -> DataFrame:
    """Deterministic uniform sample of exactly ``min(k, n)`` lines: rank by a seeded
    MD5 of the line identity and keep the lowest k (TakeOrdered, bounded)."""
    h = F.md5(F.concat_ws("\n", F.lit(str(seed)), *[F.col(c) for c in key_cols]))
    return lines.withColumn("_h", h).orderBy("_h", *key_cols).limit(k).drop("_h")


def quality_check(observations: DataFrame, required=K.REQUIRED_COLUMNS, count_parts: bool = True) -> DataFrame:
    """row_count, part_count (distinct input files of a Parquet scan), missing required
    columns, valid. ``count_parts`` needs a single-source scan (a written dataset)."""
    missing = sorted(set(required) - set(observations.columns))
    if count_parts:
        agg = (observations.select(F.input_file_name().alias("_file"))
               .agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("_file").alias("part_count")))
    else:
        agg = observations.agg(F.count(F.lit(1)).alias("row_count"))
    miss = F.array(*[F.lit(m) for m in missing]).cast("array<string>")
    return agg.select("*", miss.alias("missing_required_columns"),
                      ((F.size(miss) == 0) & (F.col("row_count") > 0)).alias("valid"))
