"""The corpus pipeline against a brute-force version of its stages."""

from __future__ import annotations

import re

import corpus_pipeline
from scanmart.llm import secret_scan
from tests.conftest import SF
from tests.llm.test_operators import (
    coverage_by_hand, expected_groups, fingerprint_by_hand, frame, measures_by_hand, odd_rows, plain, split, texts_of,
)


def by_hand(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def good(text):
        n, chars, symbols, repeats, covered = measures_by_hand(text)
        lines = [x for x in (text or "").split("\n") if split(x)]
        letters = sum(bool(re.search(r"[^\W\d_]", w)) for w in split(text))
        return not (n < 20 or 100 * covered > 30 * n or 4 * symbols > n or 10 * repeats > 7 * len(lines) or chars > 20 * n
                    or 5 * letters < 3 * n)

    docs = [(i, t) for i, t in docs if good(t)]
    yield [i for i, _ in docs]
    heads = {c for _, _, c in expected_groups([(i, fingerprint_by_hand(t, 4)) for i, t in docs], 4)}
    docs = [(i, t) for i, t in docs if i in heads]
    yield [i for i, _ in docs]
    items = [words(t) for t in bench]

    def leaks(text):
        seen = set(zip(*(w[k:] for k in range(5)))) if len(w := words(text)) >= 5 else set()
        return any(set(zip(*(x[k:] for k in range(5)))) & seen and coverage_by_hand(w, x, 5) >= 0.5 for x in items)

    docs = [(i, t) for i, t in docs if not leaks(t)]
    yield [i for i, _ in docs]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = by_hand(spark, SF)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        columns, docs = docs.columns, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        if k < 3:
            assert sorted(i for i, _ in texts_of(docs)) == sorted(next(want))
    assert not any(s[1] in (0, 1) and s[4] - s[3] > 10 for _, t in texts_of(docs) for s in secret_scan.secrets(t))
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert plain(last.collect()) == plain(corpus_pipeline.run(spark, SF).collect())
    assert last.count() == docs.count()


def test_stages_on_odd_rows(spark):
    for rows in (odd_rows(), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, SF)
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == docs.count()
