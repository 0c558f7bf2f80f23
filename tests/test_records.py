"""Raw record -> observation, NDJSON sources (plain and .zst), tolerant accounting."""

import json
import os
import tempfile

import pytest
import zstandard
from pyspark.sql import functions as F

from scanmart.operators import records as R
from scanmart.sources import ndjson as N

RICH = {
    "ip_str": "198.51.100.7", "domains": ["WWW.Harbour.example.com.\t"], "port": 8443, "timestamp": "2025-06-30T23:59:58",
    "http": {"status": 204, "title": "quay", "redirects": [{}, {}, {}], "html": "0", "securitytxt": ""},
    "vulns": {"CVE-2019-77": {"cvss": 8.1, "verified": True}, "CVE-2020-78": {"cvss": "9.9"}},
    "tags": ["eol-os"], "traefik": {"v": 3}, "rdp": None, "_scan": 1, "org": "Harbour Ltd",
    "location": {"country_code": "NO", "city": "Bergen"}, "ssl": {"subject": "CN=quay", "cert_subject": ""},
}


def obs_of(spark, records):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "sequence long, value string")
    return R.records_to_observations(df.select("sequence", F.parse_json("value").alias("v"))).collect()


def test_rich_record(spark):
    o = obs_of(spark, [RICH])[0]
    assert o.registrable_domains == ["example.com"] and o.domains == ["harbour.example.com"]
    assert o.http_status == 204 and o.http_redirect_count == 3
    assert o.http_has_html is True and o.http_securitytxt is False  # "0" is a non-empty string
    assert o.vuln_max_cvss == 8.1 and o.vuln_has_known_exploit is True  # numeric string ignored
    assert o.has_eol_tag is True and o.vuln_count == 2 and o.vuln_ids == ["CVE-2019-77", "CVE-2020-78"]
    assert o.detected_technologies == ["traefik"]  # JSON null, deny-listed and _-keys dropped
    assert o.canonical_org == "harbour" and o.country_code == "NO" and o.city == "Bergen"
    assert o.ssl_cert_subject == "CN=quay" and o.ssl_present is True
    assert o.raw_tags_json == '["eol-os"]' and o.raw_http_json.startswith('{"html"')


def test_minimal_and_wrong_types(spark):
    rows = obs_of(spark, [{"org": "Acme Inc", "domains": ["www.example.com"]},
                          {"domains": None, "location": "nowhere", "vulns": ["x"], "port": "80"}])
    a, b = rows
    assert a.canonical_org == "acme" and a.registrable_domains == ["example.com"]
    assert b.registrable_domains == [] and b.country_code is None and b.vuln_count == 0
    assert b.port is None and b.service_category is None and b.raw_vulns_json == '["x"]'
    assert b.raw_tags_json == "null"


def test_observation_id(spark):
    import hashlib

    o = obs_of(spark, [RICH])[0]
    assert o.observation_id == hashlib.sha1(b"0:198.51.100.7:2025-06-30T23:59:58:8443").hexdigest()


def test_ndjson_zst_and_tolerant(spark):
    lines = [json.dumps({"ip_str": "a", "port": 1}), "", "not json", "[1,2]", json.dumps({"ip_str": "b"})]
    d = tempfile.mkdtemp(prefix="scanmart-ndjson-")
    plain = os.path.join(d, "a.ndjson")
    with open(plain, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    zst = os.path.join(d, "b.ndjson.zst")
    with open(zst, "wb") as fh:
        fh.write(zstandard.ZstdCompressor().compress(("\n".join(lines) + "\n").encode()))
    for path in (plain, zst):
        q = N.line_quality(N.read_lines(spark, path)).first()
        assert (q.lines, q.records, q.invalid_lines) == (4, 2, 2)
        assert N.read_records(spark, path, strict=False).count() == 2
    seq = N.read_numbered_records(spark, plain, strict=False).orderBy("sequence").collect()
    assert [r.sequence for r in seq] == [0, 1]


def test_zst_without_extension_is_refused(spark):
    d = tempfile.mkdtemp(prefix="scanmart-ndjson-")
    p = os.path.join(d, "data.ndjson")
    with open(p, "wb") as fh:
        fh.write(zstandard.ZstdCompressor().compress(b'{"a":1}\n'))
    for strict in (True, False):
        with pytest.raises(Exception, match="lacks the .zst extension"):
            N.read_records(spark, p, strict=strict).count()
