"""Batch search (one plan for a table of questions) equals the single-question search.

Long domains, one- and two-letter questions, dotted tokens, keyword groups, empty and
no-match questions and score ties are mixed in; every question is also run through
the single-question operator and the ordered result lists must be equal.
"""

from __future__ import annotations

import random
import re


from pyspark.sql import functions as F

from scanmart.functions import constants as K
from scanmart.operators import search as SE


def _accounts(n: int = 120, seed: int = 5):
    rnd = random.Random(seed)
    words = ["shop", "db", "mail", "cloud", "secure", "a", "portal-eu", "x1", "payments", "api"]
    rows = []
    for i in range(n):
        name = "-".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))
        domain = f"{name}{i}.{rnd.choice(['example.com', 'test.org', 'co.uk'])}"
        rows.append((domain, rnd.choice([None, 40.0, 55.5, 61.25, 70.0]),
                     rnd.choice([None, [], ["DE"], ["US", "GB"]]),
                     *[rnd.choice([None, 0, 1, 3]) for _ in K.KEYWORD_FILTERS]))
    cols = ", ".join(f"{f} int" for _, f in K.KEYWORD_FILTERS)
    return rows, f"domain string, opportunity_score double, countries array<string>, {cols}"


QUESTIONS = ["exposed mysql database", "example.com", "shop", "a", "db", "  ", "zzqx qqzv", "portal-eu cloud",
             "test.org payments", "US", "x1.", "critical vulns in secure api", "eol legacy gb"]


def test_search_batch_equals_single(spark):
    rows, schema = _accounts()
    accounts = spark.createDataFrame(rows, schema)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    got: dict[int, list[str]] = {}
    for r in SE.search_batch(accounts, questions, limit=15).collect():
        got.setdefault(r["question_id"], []).append((r["search_rank"], r["domain"]))
    for qid, text in enumerate(QUESTIONS):
        want = [r["domain"] for r in SE.search_accounts(accounts, text, 15).collect()]
        assert [d for _, d in sorted(got.get(qid, []))] == want, text


def test_neither_the_gram_index_nor_the_terms_are_broadcast(spark):
    rows, schema = _accounts()
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    plan = SE.search_batch(spark.createDataFrame(rows, schema), questions, limit=15)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"SortMergeJoin \[g#\d+\], \[g#\d+\], Inner", plan)) >= 1
    assert not re.search(r"BroadcastHashJoin \[(g|s)#[^\]]*\], \[(g|s)#[^\]]*\], Inner", plan)


def test_no_text_of_an_account_is_shuffled(spark):
    rows, schema = _accounts()
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    plan = SE.search_batch(spark.createDataFrame(rows, schema), questions, limit=15)._jdf.queryExecution().executedPlan()
    moved, plans = [], [plan]
    while plans:
        p = plans.pop()
        if p.nodeName() in ("Exchange", "Sort"):
            moved.append(p.output().mkString(","))
        p = p.initialPlan() if p.nodeName() == "AdaptiveSparkPlan" else p
        plans += [p.children().apply(i) for i in range(p.children().size())]
    assert len(moved) > 5 and not [m for m in moved if "_hay" in m or "_dom" in m]
    # the questions' matches are ranked once
    assert len([m for m in moved if m.startswith("question_id#") and "_score#" in m]) <= 4


def test_questions_without_id_and_repeated_ones(spark):
    rows, schema = _accounts()
    accounts = spark.createDataFrame(rows, schema)
    asked = [(1, "shop"), (1, "mail"), (2, "zzqx"), (2, "qqzv"), (2, " "), (3, "shop shop"), (None, "db"), (None, "zzqx"), (4, None), (5, "zzqx")]
    found = SE.search_batch(accounts, spark.createDataFrame(asked, "question_id long, question string"), limit=7).collect()
    first = [r["domain"] for r in SE.search_accounts(accounts, "", 7).collect()]
    best = lambda *texts: [r["domain"] for r in accounts.filter(F.expr(" or ".join(f"contains(lower(domain), '{t}')" for t in texts)))
                           .orderBy(F.desc(F.coalesce("opportunity_score", F.lit(0.0))), "domain").limit(7).collect()]
    want = {1: best("shop", "mail"), 2: first * 3, 3: best("shop"), None: best("db") + first * 2, 4: first, 5: first}
    for i, domains in want.items():
        got = [(r["search_rank"], r["domain"]) for r in found if r["question_id"] == i]
        assert sorted(got) == sorted((k % 7 + 1, d) for k, d in enumerate(domains)), i
    assert len(found) == sum(map(len, want.values()))


def test_a_task_keeps_the_first_rows_of_each_term(monkeypatch):
    """Small slices, rows handed on early, ties, odd scores and texts: equals a search through all rows."""
    import pyarrow as pa

    from scanmart.operators import grams as G

    rnd = random.Random(7)
    letters = ["a", "b", "ab", "é", "ß", ".", "日本", "ba-", " "]
    word = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    texts = [(word(9), word(4)) for _ in range(400)] + [("ab" * 900, "é" * 300)]
    rows = [(None if not k % 50 else d, rnd.choice([0.0, -0.0, 1.5, 2.25, float("nan")]), d, f"{d} {c}") for k, (d, c) in enumerate(texts)]
    terms = sorted({(word(4), rnd.choice("dh")) for _ in range(300)} - {("", "d"), ("", "h")}) + [("ab" * 40, "d"), ("zz", "h")]
    numbered = [r for b in G.spelled([pa.RecordBatch.from_pylist([{"s": s, "kind": k} for s, k in terms])]) for r in b.to_pylist()]
    often = {}
    for b in G.counted([pa.RecordBatch.from_pylist([{"_hay": r[3]} for r in rows])]):
        for r in b.to_pylist():
            often[r["g"]] = often.get(r["g"], 0) + r["n"]
    grams = {}
    for r in numbered:
        grams.setdefault((r["s"], r["kind"]), []).append((often.get(r["g"], 0), r["g"]))
        assert r["grams"] == len({r["s"].encode()[i:i + 3] for i in range(max(1, len(r["s"].encode()) - 2))})
    assert sorted(grams) == sorted(terms)
    listed = [{"s": s, "kind": k, "g": min(g)[1]} for (s, k), g in grams.items()]
    schema = pa.schema([("domain", pa.string()), ("_score", pa.float64()), ("_n", pa.int32()), ("_hay", pa.string()), ("_first", pa.bool_()),
                        ("_terms", pa.list_(pa.struct([("s", pa.string()), ("kind", pa.string()), ("g", pa.int32())])))])
    as_row = lambda r, first, t=None: dict(zip(schema.names, (r[0], r[1], len(r[2].encode()), r[3], first, t)))
    stream = [as_row(rows[0], True, listed[:50]), as_row(rows[0], True), as_row(rows[0], True, listed[50:])] + [as_row(r, False) for r in rows[1:]]
    batches = lambda n: [pa.RecordBatch.from_pylist(stream[i:i + n], schema) for i in range(0, len(stream), n)]
    limit = 6
    order = lambda r: (r[1] == r[1], -r[1] if r[1] == r[1] else 0.0, r[0] is not None, (r[0] or "").encode())
    want = {(s, k): sorted(map(order, (r for r in rows if s in (r[2] if k == "d" else r[3]))))[:limit] for s, k in terms}
    for slice_bytes, held, n in ((1 << 20, 1 << 18, 1000), (300, 1 << 18, 64), (300, 40, 1), (1, 1, 7)):
        monkeypatch.setattr(G, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(G, "HELD_ROWS", held)
        got = {}
        for b in G.first_matches(limit)(iter(batches(n))):
            for r in b.to_pylist():
                got.setdefault((r["s"], r["kind"]), []).append(order((r["domain"], r["_score"])))
        assert {k: sorted(v)[:limit] for k, v in got.items()} == {k: v for k, v in want.items() if v}
