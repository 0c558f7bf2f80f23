"""Column functions: normalization, suffixes, scoring pieces, JSON truthiness."""

import json

from pyspark.sql import functions as F

from scanmart.functions import columns as C
from scanmart.operators import records as R
from scanmart.sources import suffixes as PSL


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_normalize_domain(spark):
    assert one(spark, C.normalize_domain(F.col("x")), "WWW.Example.COM.") == "example.com"
    assert one(spark, C.normalize_domain(F.col("x")), "  ") is None
    assert one(spark, C.normalize_domain(F.col("x")), "www.www.a.com") == "www.a.com"


def test_normalize_org(spark):
    assert one(spark, C.normalize_org_ascii(F.col("x")), " Google LLC ") == "google"
    assert one(spark, C.normalize_org_ascii(F.col("x")), "Acme Inc") == "acme"
    assert one(spark, C.normalize_org_ascii(F.col("x")), "Inc") == "inc"  # one word is kept
    assert one(spark, C.normalize_org_ascii(F.col("x")), "A & B Co Ltd") == "a and b"


def test_org_unicode(spark):
    df = spark.createDataFrame([("Straße GmbH",), ("Ｃａｆé Inc",), (None,)], "org string")
    out = {r["org"]: r["canonical_org"] for r in R.with_canonical_org(df, "org", "canonical_org").collect()}
    assert out["Straße GmbH"] == "strasse"
    assert out["Ｃａｆé Inc"] == "café"
    assert out[None] is None


def test_profile_org_two_word(spark):
    from scanmart.operators.profiling import canonical_profile_org

    assert one(spark, canonical_profile_org(F.col("x")), "Siemens AG Co") == "siemens"
    assert one(spark, canonical_profile_org(F.col("x")), "Foo Corporation") == "foo"


def test_registrable_domain(spark):
    cases = {"www.bbc.co.uk": "bbc.co.uk", "a.b.example.com": "example.com", "foo.ck": None,
             "www.ck": "www.ck", "1.2.3.4": None, "co.uk": None, "nosuch.zzzz": None,
             "x.github.io": "github.io", "": None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r["h"]: r["r"] for r in df.select("h", PSL.registrable_domain("h").alias("r")).collect()}
    assert got == cases


def test_service_category(spark):
    assert one(spark, C.service_category(F.col("x")), 22, "x int") == "remote_access"
    assert one(spark, C.service_category(F.col("x")), 8080, "x int") is None


def test_log_score_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 3, 10, 1000)], "v int")
    vals = [r[0] for r in df.select(C.log_score(F.col("v"), 3)).collect()]
    assert vals[0] == 0.0 and vals[2] == 100.0 and vals[-1] == 100.0 and 0 < vals[1] < 100


def test_json_truthy(spark):
    texts = ['null', 'false', '0', '0.0', '""', '[]', '{}', 'true', '1', '"a"', '[0]', '{"a":null}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(R.truthy(F.parse_json("t"))).collect()]
    assert got == [bool(json.loads(t)) for t in texts]


def test_json_type(spark):
    texts = ['null', 'true', '3', '3.5', '[1]', '{"a":1}', '"s"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.json_type(F.parse_json("t"))).collect()]
    assert got == ["null", "bool", "int", "float", "array", "object", "string"]


def test_icp_orders_org_above_cdn(spark):
    rows = [(12, 4, ["nginx", "openssh"], 0, ["US"]), (250, 1, ["cloudflare"], 40, [])]
    df = spark.createDataFrame(rows, "ips int, svc int, tech array<string>, cloud int, countries array<string>")
    a, b = [r[0] for r in df.select(C.icp_score(F.col("ips"), F.col("svc"), F.col("tech"), F.col("cloud"),
                                                 F.col("countries"))).collect()]
    assert a > b and 0 <= b <= 100 and 0 <= a <= 100


def test_opportunity_library_all_100(spark):
    from scanmart.operators.scoring import opportunity_library

    df = spark.createDataFrame([(100.0, 100.0, 100.0, 100.0, 100.0)],
                               "icp_score double, exposure_score double, vulnerability_score double, "
                               "technology_score double, recency_score double")
    assert abs(opportunity_library(df).first()["opportunity_library_score"] - 100.0) < 1e-9
