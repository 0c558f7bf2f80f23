"""Merkle manifest, conversation repair and weighted sampling against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanmart.llm import conversation_repair as CR
from scanmart.llm import merkle_manifest as MM
from scanmart.llm import queries
from scanmart.llm import weighted_sampling as WS
from tests.conftest import SF
from tests.llm.test_operators import frame, odd_rows

# 11 Merkle manifest ----------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_by_hand(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def manifest_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, text, lang, source, n_chars) rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(*r)))
        groups.append((own, levels_by_hand([leaf_by_hand(*r) for r in own])))
    top = levels_by_hand([g[1][-1][0] for g in groups])
    for k, (own, tree) in enumerate(groups):
        for i, r in enumerate(own):
            way = [(level, i >> j) for j, level in enumerate(tree[:-1])] + [(level, k >> j) for j, level in enumerate(top[:-1])]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node, siblings = leaf_by_hand(*r[:4], r[4] + 1) if tampered else leaf_by_hand(*r), []
            for level, at in way:
                run = list(level[at // 2 * 2:at // 2 * 2 + 2])
                siblings += [x for j, x in enumerate(run) if j != at % 2]
                run[at % 2] = node
                node = sha(*run)
            yield r[0], leaf_by_hand(*r), tree[-1][0], top[-1][0], sha(*siblings), node, node == top[-1][0]


def many_rows(n, langs, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 3 * n), f"text {i % (n // 3 + 1)} é", rng.choice(langs), rng.choice(["a", None]), rng.choice([None, i])) for i in range(n)]
    return rows + rows[:n // 5]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_matches_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(MM, "LEVELS", levels)
    for rows in (odd_rows(), many_rows(120, ["en", "de", None, "", "ü", "z", "y", "x", "w"]), many_rows(40, ["en"]), [(1, None, None, None, None)]):
        got = MM.checked(frame(spark, rows)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(manifest_by_hand(rows), key=repr)


def test_manifest_of_nothing(spark):
    assert MM.checked(frame(spark, [])).collect() == []
    assert MM.manifest(frame(spark, [])).children().collect() == []


def test_store_and_requests(spark, monkeypatch):
    monkeypatch.setattr(MM, "LEVELS", 2)
    rows = [r for r in many_rows(90, ["en", "de", None]) if r[0] is not None]
    of = MM.manifest(frame(spark, rows))
    store = {r["digest"]: r["children"] for r in of.children().collect()}
    assert all(d == sha(*c) for d, c in store.items())
    reached, todo = Counter(), [of.groups.first()["root"]]
    while todo:
        node = todo.pop()
        if node in store:
            todo += store[node]
        else:
            reached[node] += 1
    assert reached == Counter(leaf_by_hand(*r) for r in rows)
    key = lambda r: (r["grp"], r["doc_id"], r["leaf"], tuple(map(tuple, r["path"])))
    every = sorted(map(key, MM.proofs(of).collect()))
    asked = {r[0] for r in rows[::9]}
    some = MM.proofs(of, spark.createDataFrame([(i,) for i in asked] * 2 + [(-5,), (None,)], "doc_id long"))
    assert sorted(map(key, some.collect())) == [x for x in every if x[1] in asked]


# 12 conversation repair ------------------------------------------------------------------

DUE = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def edits_by_hand(rows, state=0, at=0, inserts=0):
    """The least (cost, audit) of all sequences of edits."""
    best = (0, "") if at == len(rows) and state in (0, 3) else (10 ** 9, "")
    if inserts < 2:
        cost, audit = edits_by_hand(rows, DUE[state], at, inserts + 1)
        best = min(best, (cost + 2, "I" + audit))
    if at < len(rows):
        letter, fault = rows[at]
        cost, audit = edits_by_hand(rows, state, at + 1)
        best = min(best, (cost + 3, "D" + audit))
        if fault not in (1, 2):
            cost, audit = edits_by_hand(rows, DUE[state], at + 1)
            best = min(best, (cost + 2 + (fault == 3), "R" + audit))
            if (state, letter) in KEPT:
                cost, audit = edits_by_hand(rows, KEPT[state, letter], at + 1)
                best = min(best, (cost + (fault == 3), "K" + audit))
    return best


def edits_by_table(rows):
    """The same for long conversations: the least (cost, whole audit) for each last role, turn by turn."""
    front = {0: (0, "")}

    def inserted(front):
        for _ in range(3):
            for state, (cost, audit) in list(front.items()):
                front[DUE[state]] = min(front.get(DUE[state], (10 ** 9, "")), (cost + 2, audit + "I"))
        return front

    for letter, fault in rows:
        new = {}
        for state, (cost, audit) in inserted(front).items():
            options = [("D", 3, state)]
            if fault not in (1, 2):
                options += [("R", 2 + (fault == 3), DUE[state])]
                options += [("K", int(fault == 3), KEPT[state, letter])] if (state, letter) in KEPT else []
            for edit, more, to in options:
                new[to] = min(new.get(to, (10 ** 9, "")), (cost + more, audit + edit))
        front = new
    return min(v for s, v in inserted(front).items() if s in (0, 3))


def solved(rows):
    repair = CR.Repair()
    for row in rows:
        repair.add(*row)
    return repair.result()


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_cheapest_edits(monkeypatch, block):
    monkeypatch.setattr(CR, "BLOCK_ROWS", block)
    rng = random.Random(block)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
        assert solved(rows) == edits_by_hand(rows) == edits_by_table(rows)
    for _ in range(40):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 0, 1, 3])) for _ in range(rng.randint(30, 300))]
        assert solved(rows) == edits_by_table(rows)
    for word in ("u", "a", "s", "ua", "au", "uuaa", "x"):
        rows = [(c, 0) for c in (word * 200)[:200]]
        assert solved(rows) == edits_by_table(rows)


def test_a_long_conversation_takes_linear_time():
    cost, audit = solved([(c, i % 4 and 3) for i, c in enumerate("uuaaxs" * 20_000)])
    assert len(audit.replace("I", "")) == 120_000


def repaired_by_hand(turns):
    """One row per conversation of (conv_id, turn, role, text, copies) rows."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())
    white = " \t\n\x0b\x0c\r"
    for conv_id in {r[0] for r in turns}:
        rows = sorted((r for r in turns if r[0] == conv_id for _ in range(r[4])), key=order)
        seen, faults = set(), []
        for _, _, role, text, _ in rows:
            end = text.rstrip(white)[-1:]
            faults.append(1 if not end else 2 if (role, text) in seen else 0 if end in (".", "!", "?") else 3)
            seen.add((role, text))
        numbers = {r[1] for r in rows} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = edits_by_table([(r[2][:1], f) for r, f in zip(rows, faults)])
        state, out, left = 0, [], list(rows)
        for edit in audit:
            row = None if edit == "I" else left.pop(0)
            if edit == "K":
                state = KEPT[state, row[2][:1]]
                out.append(f"{row[2]}:{row[3]}")
            elif edit != "D":
                state = DUE[state]
                out.append(("user:" if state == 2 else "assistant:") + (row[3] if row else ""))
        yield conv_id, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(out))


def damaged_by_hand(rows):
    for conv_id, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        yield conv_id, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)


def test_repair_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(repaired_by_hand(list(damaged_by_hand(rows))))


def odd_turns():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "Yes.", "Yes. \r\n", "no end", "What?\x0b", "a" * 50_000 + "!", " ", "Ja."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "usher"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2, 3, 7, -4]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    # one turn that is dropped, a long conversation, extreme turns
    dropped = next(i for i in range(10 ** 6, 2 * 10 ** 6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "Hi."), (9, 2 ** 62, "user", "x."), (9, -2 ** 61, "assistant", "y.")]
    return rows + [(50, i, rng.choice(["user", "user", "assistant"]), rng.choice(["Go.", "So be it", f"n{i}."])) for i in range(700)]


def test_repair_of_odd_turns(spark):
    rows = odd_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for extra in ("copies", "digest", "audit", "cost", "kind", "seen", "c", "first"):
        df = df.withColumn(extra, F.lit("extra"))
    got = CR.repaired(CR.damaged(df)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(repaired_by_hand(list(damaged_by_hand(rows))), key=repr)
    assert CR.repaired(CR.damaged(df.limit(0))).collect() == []


# 13 consistent weighted sampling ---------------------------------------------------------


def weights(text):
    return {w: 1 + math.log(n) for w, n in Counter(text.encode().lower().split()).items()}


def generalised_jaccard(a, b):
    a, b = weights(a), weights(b)
    both = a.keys() | b.keys()
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in both) / sum(max(a.get(w, 0), b.get(w, 0)) for w in both)


def test_collision_rate_is_generalised_jaccard():
    rng, sampler = random.Random(4), WS.Sampler(4096)
    for size in (3, 12, 60):
        for share in (0.2, 0.6, 0.95):
            common = [f"w{rng.randint(0, size)}" for _ in range(int(4 * size * share))]
            a, b = (" ".join(common + [f"{x}{rng.randint(0, size)}" for _ in range(4 * size - len(common))]) for x in "ab")
            want = generalised_jaccard(a, b)
            got = WS.alike(sampler.signature(a.encode()), sampler.signature(b.encode()))
            assert abs(got - want) < 4 * math.sqrt(want * (1 - want) / 4096) + 0.002, (size, share, got, want)


def test_gamma_quantiles():
    x = WS.gamma_quantiles(1000).astype(float)
    assert np.allclose(1 - (1 + x) * np.exp(-x), (np.arange(1000) + 0.5) / 1000, atol=1e-6)


def test_signature_is_the_least_of_the_terms(monkeypatch):
    text = b"b a a c c c D d e " + b" ".join(b"x%d" % (i % 70) for i in range(200))
    counts = Counter(text.lower().split())
    assert len(counts) == 75 and max(counts.values()) == 3
    each = [WS.drawn(np.array([WS.xxhash.xxh64_intdigest(w, WS.SEED)], np.uint64), np.array([n]), 64)[0] for w, n in counts.items()]
    want = [int(min(v[j] for v in each).view(np.uint64)) & 0xFFFF for j in range(64)]
    for kept, at_once in ((1 << 16, 1 << 12), (8, 5), (76, 10)):  # values kept, or drawn anew in small parts
        monkeypatch.setattr(WS, "TERMS_AT_ONCE", at_once)
        sampler = WS.Sampler(64, kept)
        assert sampler.signature(text).tolist() == want == sampler.signature(text).tolist()


def successors_by_hand(spark, docs):
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["key"], r["text"]) for r in WS._keyed(docs).collect())
    for a, b in zip(rows, rows[1:] + rows[:1]):
        quarter = len(a[3]) // 4
        changed = a[3][:len(a[3]) - quarter] + b[3][:quarter]
        sampler = WS.Sampler()
        own, other, after = (sampler.signature(t.encode()) for t in (a[3], changed, b[3]))
        near = lambda x, y: 1.0 if x is y is None else 0.0 if x is None or y is None else float(np.mean(x == y))
        yield (a[1] if a[0] else None, len(a[3]), sha(changed), WS.text_of(own, 128), WS.text_of(other, 128), near(own, other), near(own, after))


def test_successors_match_brute_force(spark):
    hot = [(7, f"text {i} of the same id", None, None, None) for i in range(40)]
    for rows, ranges in ((odd_rows(), 1), (odd_rows() + hot, 6), (odd_rows() + hot, 64), ([(5, "only one", None, None, None)], 4)):
        docs = frame(spark, rows)
        got = WS.with_successor(docs, ranges=ranges).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(successors_by_hand(spark, docs), key=repr)
    assert WS.with_successor(frame(spark, [])).collect() == []


def test_fingerprint_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op13_document_fingerprints(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(successors_by_hand(spark, docs))
    alone = {r["doc_id"]: r["fingerprint"] for r in WS.fingerprints(docs).collect()}
    assert alone == {r["doc_id"]: r["fingerprint"] for r in got}
    # the likeness of an edited text is near the similarity of the weights
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(text)
    off = [r["near_edited"] - generalised_jaccard(text[r["doc_id"]], WS.edited(text[r["doc_id"]], text[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]))
           for r in got if (text[r["doc_id"]] or "").split()]
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.25
    pairs = docs.select(F.lit(alone[ids[0]]).alias("a"), F.lit(alone[ids[1]]).alias("b")).limit(1)
    a, b = alone[ids[0]], alone[ids[1]]
    same = sum(a[i:i + 4] == b[i:i + 4] for i in range(0, len(a), 4)) / 128
    assert pairs.select(WS.likeness(F.col("a"), F.col("b"))).first()[0] == same
