"""Accounts and services marts against a brute-force Python computation.

The fixture has one hot domain holding a third of the rows, null and empty lists,
null counts and bad timestamps, so the two-level distinct path, the null/empty list
rules and the all-null sums are all exercised.
"""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from scanmart.operators import marts as M
from scanmart.operators import scoring as SC

SCHEMA = ("timestamp string, ip_str string, hostname string, port int, service_category string, "
          "cloud_present boolean, cloud_provider string, country_code string, region_code string, "
          "registrable_domains array<string>, detected_technologies array<string>, "
          "detected_services array<string>, vuln_count int, vuln_max_cvss double, has_eol_tag boolean, "
          "database_service_count int, remote_access_service_count int")


def _rows(n: int = 600, seed: int = 7):
    rnd = random.Random(seed)
    techs = ["nginx", "ssh", "redis", "mysql", "apache"]
    out = []
    for i in range(n):
        hot = i % 3 == 0
        doms = ["hot.example"] if hot else rnd.choice([[f"d{i % 17}.test"], [f"d{i % 5}.test", "hot.example"], [], None])
        ts = rnd.choice([f"2024-01-{1 + i % 28:02d}T10:00:00", "not a time", None])
        cvss = rnd.choice([None, 5.0, 7.5, 9.8])
        out.append((
            ts, f"10.0.{i % 40}.{i % 7}", rnd.choice([None, f"h{i % 11}"]), rnd.choice([None, 22, 443, 3306]),
            rnd.choice([None, "web", "remote_access"]), rnd.choice([None, True, False]), rnd.choice([None, "AWS"]),
            rnd.choice([None, "DE", "US"]), rnd.choice([None, "BY"]), doms,
            rnd.choice([None, [], rnd.sample(techs, 2)]), rnd.choice([None, [], ["ssh"], ["mysql", "ssh"]]),
            rnd.choice([None, 0, 2]), cvss, rnd.choice([None, True, False]), rnd.choice([None, 0, 1]),
            rnd.choice([None, 0, 1]),
        ))
    return out


def _ts(text):
    try:
        return dt.datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


def _expected(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    per: dict[str, list[dict]] = {}
    for r in rows:
        rec = dict(zip(names, r))
        for d in rec["registrable_domains"] or []:
            per.setdefault(d, []).append(rec)
    out = {}
    for d, recs in per.items():
        def distinct(c):
            return len({str(x[c]) for x in recs if x[c] is not None})

        def values(c):
            v = sorted({x[c] for x in recs if x[c] is not None})
            return v or None

        def nsum(vals):
            vals = [v for v in vals if v is not None]
            return sum(vals) if vals else None
        tss = [t for t in (_ts(x["timestamp"]) for x in recs) if t is not None]
        cvss = [x["vuln_max_cvss"] for x in recs]
        out[d] = dict(
            first_seen=min(tss) if tss else None, last_seen=max(tss) if tss else None,
            observation_count=len(recs), unique_ip_count=distinct("ip_str"),
            unique_hostname_count=distinct("hostname"), unique_port_count=distinct("port"),
            unique_service_count=distinct("service_category"),
            cloud_observation_count=sum(1 for x in recs if x["cloud_present"]),
            identified_cloud_observation_count=sum(1 for x in recs if x["cloud_present"] and x["cloud_provider"]),
            countries=values("country_code"), regions=values("region_code"), cloud_providers=values("cloud_provider"),
            technologies=sorted({t for x in recs for t in (x["detected_technologies"] or [])}),
            services=sorted({t for x in recs for t in (x["detected_services"] or [])}),
            vulnerability_count=nsum(x["vuln_count"] for x in recs),
            critical_vulnerability_observations=sum(1 for c in cvss if c is not None and c >= 9.0),
            high_vulnerability_observations=sum(1 for c in cvss if c is not None and 7.0 <= c < 9.0),
            eol_observation_count=sum(1 for x in recs if x["has_eol_tag"]),
            exposed_database_count=nsum(x["database_service_count"] for x in recs),
            exposed_remote_access_count=nsum(x["remote_access_service_count"] for x in recs),
        )
    return out


def test_accounts_mart_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["domain"]: r.asDict() for r in M.accounts_mart(df).collect()}
    want = _expected(rows)
    assert set(got) == set(want)
    assert want["hot.example"]["observation_count"] >= len(rows) // 3
    for d, exp in want.items():
        row = got[d]
        assert row["account_id"] == d
        for k, v in exp.items():
            assert row[k] == v, (d, k, row[k], v)
    assert list(M.accounts_mart(df).columns) == list(M.ACCOUNT_COLUMNS)


def test_services_mart_brute_force(spark):
    rows = _rows(300, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["domain"], r["service"]): r["observation_count"] for r in M.services_mart(df).collect()}
    want: dict[tuple, int] = {}
    for r in rows:
        for d in r[9] or []:
            for s in r[11] or []:
                want[(d, s)] = want.get((d, s), 0) + 1
    assert got == want


def test_org_mart_brute_force(spark):
    rnd = random.Random(11)
    rows = [(("hot" if i % 3 == 0 else rnd.choice([None, "acme", "globex", "initech"])),
             rnd.choice([None, f"10.0.0.{i % 23}"]), rnd.choice([None, f"2024-02-{1 + i % 9:02d}T00:00:00"]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "canonical_org string, ip_str string, timestamp string")
    got = {r["canonical_org"]: (r["observation_count"], r["unique_ip_count"], r["last_observed_at"])
           for r in M.org_mart(df).collect()}
    want = {}
    for org in {r[0] for r in rows if r[0] is not None}:
        recs = [r for r in rows if r[0] == org]
        ts = [r[2] for r in recs if r[2] is not None]
        want[org] = (len(recs), len({r[1] for r in recs if r[1] is not None}), max(ts) if ts else None)
    assert got == want
    ips = M.org_ips(df).filter("canonical_org = 'hot'").count()
    assert ips == want["hot"][1]


def test_reference_time_from_the_sightings(spark):
    """The latest time of all accounts from the observations: same scores, and the accounts' facts are shuffled once."""
    rows = _rows()
    late = ["2031-01-01T00:00:00" if c == "timestamp" else [] if c == "registrable_domains" else v
            for c, v in zip((c.split()[0] for c in SCHEMA.split(", ")), rows[0])]
    obs = spark.createDataFrame([*rows, tuple(late)], SCHEMA)
    accounts = M.accounts_mart(obs)
    other, same = SC.scored_accounts(accounts), SC.scored_accounts(accounts, M.sightings(obs))
    assert same.columns == other.columns and same.count() == other.count() > 3
    assert not other.exceptAll(same).count()
    latest = lambda df: df.agg(F.max("last_seen")).first()[0]
    assert latest(M.sightings(obs)) == latest(accounts) == dt.datetime(2024, 1, 28, 10)
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(domain")
    assert 2 * moved(same) == moved(other) > 0
