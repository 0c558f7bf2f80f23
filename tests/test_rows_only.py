"""Value checks for the queries the DuckDB oracle can only count: the fixed-size
sample, the canonical JSON text and the prompt cache key."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from scanmart.operators import evidence as EV
from scanmart.operators import profiling as P


def test_sample_fixed_exact_deterministic(spark):
    lines = spark.range(5000).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("line"))
    a = [r["line"] for r in P.sample_fixed(lines, 300, 42).collect()]
    b = [r["line"] for r in P.sample_fixed(lines.repartition(7), 300, 42).collect()]
    c = {r["line"] for r in P.sample_fixed(lines, 300, 43).collect()}
    assert len(a) == 300 and len(set(a)) == 300
    assert a == b  # independent of the partitioning
    assert set(a) != c  # the seed matters
    assert set(a) <= {str(i) for i in range(5000)}
    assert P.sample_fixed(lines, 9000, 42).count() == 5000  # k > n keeps everything
    # roughly uniform: both halves of the id range are represented
    low = sum(1 for x in a if int(x) < 2500)
    assert 90 < low < 210


def test_canonical_json_sorted_compact(spark):
    texts = ['{"b": 1, "a": [1, 2], "c": {"z": null, "y": "é"}}', "[3, 1]", '"x"', "null"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.to_json(F.parse_json("t"))).collect()]
    assert got[0] == '{"a":[1,2],"b":1,"c":{"y":"é","z":null}}'
    for t, g in zip(texts, got):
        assert json.loads(g) == json.loads(t)
        assert g == json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_prompt_cache_key(spark):
    ev = spark.createDataFrame([("a.example", 1, "x"), ("b.example", 2, "ü")],
                               "domain string, n int, s string").select(
        "domain", F.struct("n", "s").alias("evidence"))
    rows = EV.prompts(ev, "Audit the account.", "audit/v2", "m-1").collect()
    assert len(rows) == 2
    for r in rows:
        assert r["prompt"].startswith("Audit the account.\n\n")
        body = r["prompt"].split("```json\n", 1)[1].rsplit("\n```", 1)[0]
        assert set(json.loads(body)) == {"n", "s"}
        want = "audit/v2:" + hashlib.sha256(("m-1\n" + r["prompt"]).encode("utf-8")).hexdigest()
        assert r["cache_key"] == want
