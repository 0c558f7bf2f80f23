"""Language identification with error-correcting output codes.

Every language gets a codeword; for each bit of the code a binary classifier over hashed
byte n-grams predicts on which side of the split a text lies. Decoding sums, per codeword,
the loss of the predicted margins against its bits, weighted by how reliable each bit's
classifier is, and takes the nearest codeword; a small lead over the second is flagged.

Training texts are a sample of bounded size (``per_language`` texts, ``max_texts`` in all),
drawn by a hash of the row from all labelled rows; each bit is trained in its own task.
Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import raw_texts, sliced

HASH_BITS = 13
SIZES = (2, 3, 4)
PER_LANGUAGE, MAX_TEXTS = 300, 3000
RIDGE = 0.02
#: Lead in loss below which a prediction is flagged as ambiguous.
LEAD = 1.0

_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_STEP = 1 << 20


def features(text: bytes) -> np.ndarray:
    """Unit vector of the square roots of a whole text's hashed n-gram counts (letters and word edges)."""
    text = b" " + b" ".join(text.lower().translate(_LETTERS).split()) + b" "
    counts = np.zeros(1 << HASH_BITS, np.int64)
    for at in range(0, len(text), _STEP):
        a = np.frombuffer(text[at:at + _STEP + max(SIZES) - 1], np.uint8).astype(np.uint32)
        code = a
        for n in range(2, max(SIZES) + 1):
            code = (code[:-1] << np.uint32(8)) | a[n - 1:]
            if n in SIZES:
                mixed = (code * np.uint32(2654435761) + np.uint32(n)) * np.uint32(2246822519) >> np.uint32(32 - HASH_BITS)
                counts += np.bincount(mixed[:_STEP], minlength=1 << HASH_BITS)
    out = np.sqrt(counts).astype(np.float32)
    return out / max(np.linalg.norm(out), 1e-9)


def code_words(n: int, seed: int = 42) -> np.ndarray:
    """(n, bits) of -1 / 1: all splits of up to five languages, else the best of seeded random codes."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 5:
        splits = [s for s in product((-1, 1), repeat=n) if s[0] == 1 and len(set(s)) > 1]
        return np.array(splits, np.float32).T
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(50):
        code = rng.choice([-1, 1], (n, bits)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - (code @ code.T - np.eye(n) * 4 * bits).max()) / 2
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


def _has_letter(text: bytes | None) -> bool:
    return bool(text) and any(map(str.isalpha, text.decode()))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_texts: int = MAX_TEXTS):
    """(languages, code, weights, reliability) learned from rows (text, lang), nulls left out.

    Copies count once: texts of a language are told apart by a 64-bit hash before they are counted
    and drawn, so a text with many copies is one text of the sample."""
    rows = labelled.where("text is not null and lang is not null and text rlike '\\\\p{L}'").select("text", "lang", F.xxhash64("text").alias("_hash"))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "_hash").distinct().groupBy("lang").count().collect()}
    languages = sorted(counts)
    code = code_words(len(languages))
    if len(languages) < 2:
        return languages, code, np.zeros((1 << HASH_BITS, 0), np.float32), np.zeros(0, np.float32)
    take = max(10, min(per_language, max_texts // len(languages)))
    # about twice the texts wanted, then exactly those with the lowest hashes
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 2 * take / counts[lang] + 0.01))])
    draw = F.pmod(F.col("_hash"), F.lit(1 << 30))
    near = rows.where(draw < share[F.col("lang")] * float(1 << 30)).groupBy("lang", "_hash").agg(F.min("text").alias("text")).withColumn("draw", draw)
    first = W.partitionBy("lang").orderBy("draw", "text")
    sample = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= take).select("text", "lang")
    signs = F.create_map(*[
        x for lang, word in zip(languages, code.astype(int).tolist()) for x in (F.lit(lang), F.array(*map(F.lit, word)))])
    targets = sample.select("text", F.posexplode(signs[F.col("lang")]).alias("bit", "target"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text", "target"])
        x, y = np.stack([features(t.encode()) for t in pdf["text"]]), pdf["target"].to_numpy(np.float32)
        x = np.concatenate([x, np.full((len(x), 1), 0.3, np.float32)], axis=1)
        kernel = x @ x.T
        inverse = np.linalg.inv(kernel.astype(np.float64) + RIDGE * np.eye(len(x)))
        dual = inverse @ y
        left_out = y - dual / np.diag(inverse)  # each text's margin without it
        good = max(1e-3, 1 - 2 * float((left_out * y <= 0).mean()))
        return pd.DataFrame({"bit": [int(pdf["bit"].iloc[0])], "w": [(x.T @ dual.astype(np.float32)).tolist()], "good": [good]})

    found = targets.groupBy("bit").applyInPandas(fit, "bit int, w array<float>, good double").collect()
    weights = np.array([r["w"] for r in sorted(found, key=lambda r: r["bit"])], np.float32).T
    return languages, code, weights, np.array([r["good"] for r in sorted(found, key=lambda r: r["bit"])], np.float32)


def decode(margins: np.ndarray, code: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codeword, score in 0..1, lead over the second) per row of margins."""
    loss = np.logaddexp(0, -2 * margins[:, None, :] * code[None, :, :]) @ good
    order = np.sort(loss, axis=1)
    p = np.exp(order[:, :1] - loss)
    lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return loss.argmin(1), 1 / p.sum(1), lead


def identify(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row.

    Texts of any length are taken whole, a slice of bytes at a time. ``und`` with score 0 for null texts and texts without a letter, or if nothing was
    learned; one learned language is every text's. Repeated rows stay; other columns are
    ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        languages, code, weights, good = shared.value
        for part in sliced(batches):
            texts = raw_texts(part)
            known = np.array([bool(languages) and _has_letter(t) for t in texts])
            name, score, doubt = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(known)
            if len(languages) == 1:
                name[at], score[at], doubt[at] = languages[0], 1.0, False
            else:
                for chunk in (at[i:i + 256] for i in range(0, len(at), 256)):
                    x = np.stack([features(texts[i]) for i in chunk])
                    best, score[chunk], lead = decode(x @ weights[:-1] + 0.3 * weights[-1], code, good)
                    name[chunk], doubt[chunk] = np.array(languages, object)[best], lead < LEAD
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(doubt)],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean")
