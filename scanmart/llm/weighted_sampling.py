"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words in lower case, each weighing 1 + ln(count). For
each of ``samples`` positions every term draws, from its own hash alone, r and c of a
Gamma(2, 1) distribution and b of a uniform one; a term of weight S has the step
t = floor(ln S / r + b) and the value ln c - r * (t - b + 1), and the position keeps the pair
(term, t) of the least value. Two texts keep the same pair with a probability that is the
generalised Jaccard similarity of their weights, sum of minima by sum of maxima. A fingerprint
has 16 bits of each pair's hash, so a share of 2 ** -16 of other positions agrees by chance.

Fingerprints need one narrow pass. Documents that are compared with their successor by id are
dealt into ranges of ids, each with a copy of the row that follows its last, and read in order:
texts are shuffled once, and no order of the whole table is made in one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key64, raw_texts, sliced

SAMPLES = 128
SEED = 42
#: Terms whose values a task keeps (8 bytes for each position).
KEPT_TERMS = 1 << 17
#: Terms that are looked at together.
TERMS_AT_ONCE = 1 << 12
#: Terms that draw together (their arrays stay in a processor's cache).
DRAWN_AT_ONCE = 256
#: Rows of the sample that the bounds of ranges are drawn from, for each range.
SAMPLE_ROWS = 64


def gamma_quantiles(n: int) -> np.ndarray:
    """The middles of ``n`` equal shares of Gamma(2, 1): x with 1 - (1 + x) * exp(-x) = p, by Newton's method."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p  # near the curve from below, where the steps converge
    for _ in range(60):
        x -= (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300)
        x = np.clip(x, 1e-9, 60.0)
    return x.astype(np.float32)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """-ln of the middle of each of 2 ** 16 parts of (0, 1), and the quantiles of Gamma(2, 1)."""
    return -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32), gamma_quantiles(1 << 16)


def drawn(terms: np.ndarray, counts: np.ndarray, samples: int) -> np.ndarray:
    """For each term (hash) and position the value that is to be least, with 16 bits of the pair (term, t) as its last bits.

    A position has 64 random bits of the term: two uniforms whose logarithms add up to c, r and b."""
    minus_log, quantile = _tables()
    lane = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parts = key64(terms[:, None] + lane[None, :]).view("<u2").reshape(len(terms), samples, 4)
    log_c = np.log(minus_log[parts[:, :, 0]] + minus_log[parts[:, :, 1]])
    r = quantile[parts[:, :, 2]]
    b = parts[:, :, 3].astype(np.float32)
    b += np.float32(0.5)
    b *= np.float32(2.0 ** -16)
    t = np.zeros(b.shape, np.float32)
    more = counts > 1  # a term that stands once has ln S = 0 and the step 0
    if more.any():
        t[more] = np.floor(np.log1p(np.log(counts[more])).astype(np.float32)[:, None] / r[more] + b[more])
    b -= t
    values = (log_c - r * (np.float32(1) - b)).astype(np.float64).view(np.uint64)
    codes = (key64(terms) >> np.uint64(48))[:, None] + t.astype(np.int64).view(np.uint64) * np.uint64(40503)
    values &= ~np.uint64(0xFFFF)
    values |= codes & np.uint64(0xFFFF)
    return values.view(np.float64)


class Sampler:
    """Signatures of texts; what (word, count) pairs have drawn is kept, for up to ``kept`` pairs."""

    def __init__(self, samples: int = SAMPLES, kept: int = KEPT_TERMS):
        self.samples, self.kept, self.rows, self.values = samples, kept, {}, None

    def _values(self, pairs: list[tuple[bytes, int]]) -> np.ndarray:
        """The drawn values of at most ``kept`` pairs."""
        if self.values is None:
            self.values = np.empty((self.kept, self.samples))
        rows = list(map(self.rows.get, pairs))
        if None in rows:
            new = [p for p, row in zip(pairs, rows) if row is None]
            if len(self.rows) + len(new) > self.kept:
                self.rows.clear()
                new = pairs
            first = len(self.rows)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w, _ in new), np.uint64, len(new))
            counts = np.fromiter((n for _, n in new), np.int64, len(new))
            for at in range(0, len(new), DRAWN_AT_ONCE):
                some = slice(at, at + DRAWN_AT_ONCE)
                self.values[first + at:first + min(at + DRAWN_AT_ONCE, len(new))] = drawn(hashes[some], counts[some], self.samples)
            self.rows.update(zip(new, range(first, first + len(new))))
            rows = list(map(self.rows.get, pairs))
        return self.values[rows]

    def signature(self, text: bytes | None) -> np.ndarray | None:
        """16 bits for each position; None for a text without words."""
        pairs = list(Counter((text or b"").lower().split()).items())
        if not pairs:
            return None
        step = min(TERMS_AT_ONCE, self.kept)
        least = np.minimum.reduce([self._values(pairs[at:at + step]).min(axis=0) for at in range(0, len(pairs), step)])
        return least.view(np.uint64).astype(np.uint16)


def text_of(signature: np.ndarray | None, samples: int) -> str:
    """A fingerprint as hexadecimal digits, four for each position; all zero for a text without words."""
    return signature.astype(">u2").tobytes().hex() if signature is not None else "0000" * samples


def alike(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of positions at which two signatures agree; texts without words are like each other only."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs`` (doc_id, text), in one narrow pass.

    Null texts count as empty; texts of any length are taken whole; repeated rows stay; an empty
    table gives an empty result; other columns are ignored."""

    def run(batches):
        sampler = Sampler(samples)
        for part in sliced(batches):
            found = [text_of(sampler.signature(t), samples) for t in raw_texts(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): rows in an order by id (null first) and, for equal ids, by a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _place(known, doc_id, key) -> tuple:
    return bool(known), int(doc_id) if known else 0, int(key)


def _range_bounds(rows: DataFrame, ranges: int) -> tuple[list[tuple], tuple | None]:
    """(known, doc_id, key) of the first row of each range but the first, and of the first row of all.

    The bounds are rows of the table, from a sample of bounded size drawn by hash: it decides
    how evenly the ranges are filled, not what is compared."""
    keys = rows.select(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")
    place = F.struct("known", "doc_id", "key")
    total = keys.agg(F.count("*").alias("n"), F.min(place).alias("first")).first()
    if not total["n"]:
        return [], None
    share = min(1.0, SAMPLE_ROWS * ranges / total["n"])
    draw = F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    sample = sorted({_place(*r) for r in keys.where(draw).select("known", "doc_id", "key").limit(4 * SAMPLE_ROWS * ranges).collect()})
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    return bounds, _place(*total["first"])


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, after, doc_id, key, text): the rows of ``docs`` dealt into ranges of their order, each range with
    a copy (``after``) of the row that comes after its last; after the last row of all comes the first."""
    rows = _keyed(docs)
    bounds, first = _range_bounds(rows, ranges)
    if first is None:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("after"), "*")
    count = len(bounds) + 1
    starts = {b: i + 1 for i, b in enumerate(bounds)} | {first: 0}

    @F.pandas_udf("array<int>")
    def parts(doc_id: pd.Series, key: pd.Series) -> pd.Series:
        known = doc_id.notna().to_numpy()
        ids = doc_id.fillna(0).astype("int64").to_numpy()
        keys = key.to_numpy()
        # places of rows among the bounds: a bound comes before the row that is equal to it
        at = [np.concatenate([np.array([b[i] for b in bounds], np.int64), x.astype(np.int64)]) for i, x in enumerate((known, ids, keys))]
        is_row = np.arange(len(at[0])) >= len(bounds)
        order = np.lexsort((is_row, at[2], at[1], at[0]))
        passed = np.empty(len(order), np.int64)
        passed[order] = np.cumsum(~is_row[order])
        own = passed[len(bounds):]
        out = []
        for i, part in enumerate(own.tolist()):
            start = starts.get((bool(known[i]), int(ids[i]), int(keys[i])))
            out.append([part] if start is None else [part, (start - 1) % count])
        return pd.Series(out)

    dealt = rows.select("*", F.posexplode(parts("doc_id", "key")).alias("copy", "part"))
    return dealt.select("part", (F.col("copy") == 1).alias("after"), "doc_id", "key", "text")


def with_successor(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A row's successor is the next by doc_id (null first; equal ids by a hash of their texts),
    the first after the last, and itself in a table of one row. The edited text has the
    successor's start for its last quarter. See ``fingerprints`` for odd rows. A task holds two
    texts at a time besides a slice."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(samples), None
        for batch in sliced(batches):
            out = []
            for part, after, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "after", "doc_id", "text"))):
                own = sampler.signature(text.encode())
                if held is not None and held[0] == part:
                    _, before_id, before, signature = held
                    changed = edited(before, text).encode()
                    other = sampler.signature(changed)
                    out.append((before_id, len(before), hashlib.sha256(changed).hexdigest(), text_of(signature, samples),
                                text_of(other, samples), alike(signature, other), alike(signature, own)))
                held = None if after else (part, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    rows = in_ranges(docs, ranges).repartition("part").sortWithinPartitions("part", "after", F.asc_nulls_first("doc_id"), "key")
    return rows.select("part", "after", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The likeness of two fingerprint columns, in expressions."""
    same = F.lit(0)
    for i in range(samples):
        same = same + (F.substring(a, 4 * i + 1, 4) == F.substring(b, 4 * i + 1, 4)).cast("int")
    return same / samples
