"""End-to-end marts on sf0.001 plus invariants, search facts, judge, cost, workspace."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanmart.operators import evals as EVL
from scanmart.operators import search as SE
from scanmart.operators import traces as TR
from scanmart.operators import workspace as WS
from scanmart.plans import catalog as CAT
from tests.conftest import SF


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "opportunity_score" in df.columns


def test_invariants(spark):
    obs = CAT.observations(spark, SF)
    acc = CAT.accounts(spark, SF)
    sc = CAT.scored(spark, SF)
    # sum of account observation counts = sum of list sizes
    total = obs.agg(F.sum(F.size("registrable_domains"))).first()[0]
    assert acc.agg(F.sum("observation_count")).first()[0] == total
    for c in ("icp_score", "exposure_score", "vulnerability_score", "technology_score", "recency_score",
              "opportunity_score"):
        lo, hi = sc.agg(F.min(c), F.max(c)).first()
        assert 0 <= lo <= hi <= 100
    sig = CAT.signals(spark, SF)
    assert sig.count() == sig.select("signal_id").distinct().count()
    ev = CAT.evidence(spark, SF)
    assert ev.groupBy("domain").count().agg(F.max("count")).first()[0] <= CAT.EVIDENCE_PER_ACCOUNT


def test_search_facts(spark):
    accts = spark.createDataFrame([
        ("shop.example.com", 55.0, 0, 0, 0, 0, 0, ["US"]),
        ("db-open.test", 60.0, 0, 2, 0, 0, 0, ["DE"]),
        ("quiet.test", 70.0, 0, 0, 0, 0, 0, []),
    ], "domain string, opportunity_score double, critical_vulnerability_observations int, "
       "exposed_database_count int, exposed_remote_access_count int, eol_observation_count int, "
       "cloud_observation_count int, countries array<string>")
    assert SE.search_accounts(accts, "exposed mysql database").first().domain == "db-open.test"
    assert SE.search_accounts(accts, "example.com").first().domain == "shop.example.com"
    assert SE.search_accounts(accts, "zzzz qqqq").count() == 3  # no match -> all
    q = spark.createDataFrame([(1, "exposed mysql database"), (2, "example.com"), (3, "zzzz")],
                              "question_id int, question string")
    b = SE.search_batch(accts, q).filter("search_rank = 1").orderBy("question_id").collect()
    assert [r.domain for r in b] == ["db-open.test", "shop.example.com", "quiet.test"]


def test_judge(spark):
    cases = spark.createDataFrame([
        ("good", "Exposed MySQL and EOL software", ["mysql", "eol"], ["ransomware"]),
        ("bad", "They were hit by ransomware", ["mysql"], ["ransomware"]),
    ], "id string, text string, must_mention array<string>, must_not_mention array<string>")
    j = {r.id: r for r in EVL.judge(cases).collect()}
    assert j["good"].recall == 1.0 and j["good"].passed
    assert not j["bad"].passed and j["bad"].false_positives == ["ransomware"]
    s = EVL.summarize(cases.withColumn("prompt_version", F.lit("v1")).transform(EVL.judge)).first()
    assert s.cases == 2 and s.pass_rate == 0.5


def test_cost(spark):
    t = spark.createDataFrame([("gemini-2.5-flash", 1000, 500), ("nope", 1000, 500)],
                              "model string, input_tokens long, output_tokens long")
    got = [r.cost_usd for r in TR.with_cost(t, TR.rates(spark)).orderBy("model").collect()]
    assert got == [0.00045, 0.00045]


def test_workspace_sequential_semantics(spark):
    saved = spark.createDataFrame([("a.com", "t0", "o", "New", None, None, None)],
                                  "domain string, saved_at string, owner string, status string, notes string, "
                                  "next_action string, next_action_date string")
    ch = spark.createDataFrame([
        ("a.com", 1, "update", "t1", "x", "Qualified", None, None, None),
        ("a.com", 2, "delete", "t2", None, None, None, None, None),
        ("a.com", 3, "update", "t3", "y", "Contacted", None, None, None),  # no row -> no-op
        ("b.com", 4, "insert", "t4", None, None, None, None, None),
        ("b.com", 5, "insert", "t5", None, None, None, None, None),  # present -> no-op
        ("b.com", 6, "update", "t6", "z", "Bogus", None, None, None),  # invalid -> rejected
    ], "domain string, seq long, op string, changed_at string, owner string, status string, notes string, "
       "next_action string, next_action_date string")
    out = {r.domain: r for r in WS.apply_changes(saved, ch).collect()}
    assert set(out) == {"b.com"}
    assert out["b.com"].saved_at == "t4" and out["b.com"].status == "New"
    assert WS.rejected_updates(ch).count() == 1
