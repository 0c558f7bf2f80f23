"""Summaries against the exact results, merged from parts, and at their bounds."""

import math

import numpy as np
from pyspark.sql import functions as F

from scanmart.operators import marts as M
from scanmart.operators import sketches as SK
from scanmart.operators import traces as TR
from scanmart.plans import catalog as CAT
from tests.conftest import SF


def observed(spark, n):
    """One account with nearly all of ``n`` observations, over 30 days, and two small ones."""
    r = spark.range(n)
    domain = F.when(F.col("id") % 1000 == 0, "small.example.com").when(F.col("id") % 1000 == 1, "one.example.com").otherwise("hot.example.com")
    ip = F.when(F.col("id") % 1000 == 1, "10.0.0.1").otherwise(F.concat(F.lit("ip"), (F.col("id") * 7 % (n // 2)).cast("string")))
    day = F.date_add(F.to_date(F.lit("2025-01-01")), (F.col("id") % 30).cast("int"))
    return r.select(F.array(domain).alias("registrable_domains"), ip.alias("ip_str"), F.concat(F.lit("h"), F.col("id") % 50_000).alias("hostname"),
                    F.concat(day.cast("string"), F.lit("T00:00:00")).alias("timestamp"))


def test_estimates_are_within_their_error_and_merge(spark):
    obs = observed(spark, 400_000)
    daily = SK.account_sketches(obs)
    assert daily.where("domain = 'hot.example.com'").count() == 30
    got = {r["domain"]: r for r in SK.account_estimates(daily).collect()}
    exact = {r["domain"]: r for r in M.account_observations(obs).groupBy("domain").agg(
        F.count("*").alias("n"), F.countDistinct("ip_str").alias("ips"), F.countDistinct("hostname").alias("hosts")).collect()}
    assert exact["hot.example.com"]["ips"] > 150_000
    bound = 3 * 1.04 / math.sqrt(2 ** SK.LG_K)
    for d, e in exact.items():
        assert got[d]["observation_count"] == e["n"]
        assert abs(got[d]["unique_ip_estimate"] - e["ips"]) <= bound * e["ips"] + 0.5
        assert abs(got[d]["unique_hostname_estimate"] - e["hosts"]) <= bound * e["hosts"] + 0.5
    # merged in two steps: the same estimate
    weeks = daily.groupBy("domain", F.weekofyear("day").alias("week")).agg(
        F.sum("observation_count").alias("observation_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *(F.hll_union_agg(f"{n}_sketch").alias(f"{n}_sketch") for n, _ in SK.DISTINCT))
    again = {r["domain"]: r["unique_ip_estimate"] for r in SK.account_estimates(weeks).collect()}
    assert again == {d: r["unique_ip_estimate"] for d, r in got.items()}
    mart = {r["domain"]: r for r in CAT.accounts(spark, SF).collect()}
    for r in SK.account_estimates(SK.account_sketches(CAT.observations(spark, SF))).collect():
        assert (r["unique_ip_estimate"], r["first_seen"]) == (mart[r["domain"]]["unique_ip_count"], mart[r["domain"]]["first_seen"])


def skewed(spark, n):
    """Records with a field of few values, one of many even ones, and one with a few frequent among many."""
    few = F.concat(F.lit('"f'), (F.col("id") % 40).cast("string"), F.lit('"'))
    many = F.col("id").cast("string")
    # value k has a share of 2 ** -k of the records
    level = F.length(F.bin(F.col("id") + 1)) - F.length(F.rtrim(F.bin(F.col("id") + 1), F.lit("0")))
    mixed = F.when(level < 6, level).otherwise(F.col("id") + 100).cast("string")
    text = F.concat(F.lit('{"org":'), few, F.lit(',"asn":'), many, F.lit(',"port":'), mixed, F.lit("}"))
    return spark.range(n).select("id", F.parse_json(text).alias("v"))


def test_most_common_values_where_the_bound_tells(spark):
    n, k = 60_000, 10
    records = skewed(spark, n)
    fields = ("org", "asn", "port")
    parts = SK.value_summaries(records.where("id % 2 = 0"), fields, k).unionByName(SK.value_summaries(records.where("id % 2 = 1"), fields, k))
    got = {(r["field"], r["rank"]): r for r in SK.value_top_bounded(SK.merged_summaries(parts, k), k).collect()}
    want = {(r["field"], r["rank"]): r for r in CAT.P.value_top(records, fields, k).collect()}
    certain = {key for key, r in got.items() if r["certain"]}
    assert all(got[key]["value"] == want[key]["value"] for key in certain)
    assert all(got[key]["records"] - got[key]["error"] <= want[key]["records"] <= got[key]["records"] for key in certain)
    assert {key for key in certain if key[0] == "org"} == {("org", i) for i in range(1, 11)}
    assert all(got["org", i]["error"] == 0 and got["org", i]["records"] == want["org", i]["records"] for i in range(1, 11))
    assert not [key for key in certain if key[0] == "asn"]
    assert {key[1] for key in certain if key[0] == "port"} >= {1, 2, 3, 4}
    assert SK.tracked_items(10) * 3 // 4 >= 200 and SK.tracked_items(1) * 3 // 4 >= 100


def test_cells_keep_order_and_value(spark):
    values = sorted({s * v for e in range(0, 63) for v in (2 ** e - 1, 2 ** e, 2 ** e + 1, 3 * 2 ** e // 2) for s in (1, -1)})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(SK.cell(F.col("v"))).collect()]
    assert got == sorted(got)
    assert all(c == v for v, c in zip(values, got) if abs(v) < 2 ** 16)
    assert all(abs(c - v) <= abs(v) / 2 ** 12 for v, c in zip(values, got))


def test_latency_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, size in (("a", 1), ("b", 2), ("c", 4001), ("d", 1000)):
        for x in (rng.lognormal(5, 1, size).astype(int) if g != "d" else rng.integers(10 ** 6, 10 ** 9, size)).tolist():
            rows.append((g, x))
    rows += [("e", None), ("b", None), (None, 7)]
    df = spark.createDataFrame([(g, x, None if i % 7 == 0 else i % 3 == 0, "e" if i % 5 == 0 else None, i / 10) for i, (g, x) in enumerate(rows)],
                               "workflow string, latency_ms long, cached boolean, error string, cost_usd double")
    df = df.select("*", F.lit("p").alias("provider"), F.lit("2025-01-01").cast("timestamp").alias("timestamp"))
    got = {r["workflow"]: r for r in TR.rollup(df).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", None}
    for g in got:
        xs = [x for h, x in rows if h == g and x is not None]
        own = [i for i, (h, _) in enumerate(rows) if h == g]
        assert got[g]["calls"] == len(own) and got[g]["error_rate"] == round(sum(i % 5 == 0 for i in own) / len(own), 4)
        for name, level in TR.LATENCY_LEVELS.items():
            if not xs:
                assert got[g][name] is None
            elif g == "d":  # beyond the exact cells
                assert abs(got[g][name] - np.quantile(xs, level)) <= np.quantile(xs, level) / 4096 * 1.01
            else:
                assert abs(got[g][name] - np.quantile(xs, level)) < 0.0011
