"""Quality classifier: random Fourier features, ridge normal equations, isotonic calibration.

Document statistics are computed in one pass over whole texts and stored (a few numbers per
row). Random Fourier features of the standardised statistics approximate a Gaussian kernel;
each task adds up its part of the normal equations, the parts are summed by matrix entry,
and the driver solves one small system. A fifth of the training rows calibrates the ridge
scores: they are counted into a fixed number of bins and pooled to a rising step function.

Training uses at most about ``MAX_ROWS`` labelled rows, drawn by a hash of the row's key;
every row is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, sliced, stored

FOURIER, GAMMA, RIDGE, BINS = 192, 0.02, 1e-3, 1000
MAX_ROWS = 400_000

STATISTICS = (
    "log_words", "word_length", "long_words", "short_words", "distinct_words", "repeated_next", "upper", "digits", "symbols",
    "bars", "stops", "commas", "spaces", "other_ascii", "non_ascii", "log_lines", "words_per_line", "repeated_lines",
    "line_ends", "letter_words", "char_entropy", "top_word",
)

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=", b"|", b".!?", b",;:", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 8
_CLASS[[c for c in range(128) if not _CLASS[c] and not chr(c).islower() and c != 10]] = 9


def statistics(text: bytes | None) -> list[float]:
    """The document statistics of a whole text (null as empty)."""
    text = text or b""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=10) / chars
    share = counts[counts > 0] / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    n, k = max(1, n), max(1, len(lines))
    return [
        np.log1p(len(words)), sizes.mean(), (sizes > 12).mean(), (sizes < 4).mean(), len(tally) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, *kinds[1:8], kinds[9], kinds[8], np.log1p(len(lines)),
        np.log1p(len(words) / k), 1 - len(set(lines)) / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
        sum(map(bytes.isalpha, words)) / n, float(-(share * np.log2(share)).sum()), max(tally.values(), default=0) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) for every row."""

    def run(batches):
        for part in sliced(batches):
            stats = pa.array([statistics(t) for t in raw_texts(part)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), stats], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, stats array<double>")


class Model:
    """Scale, Fourier directions, ridge weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), FOURIER))
        self.phases = rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / FOURIER) * np.cos(x @ self.directions + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def pooled(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising sequence of means nearest to sums / counts."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([np.full(n, s / c) for s, c, n in blocks])


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of ``rows`` (doc_id, stats, label 0/1, one per document); without rows every score is 0.5."""
    d = len(STATISTICS)
    total = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20))
    rows = rows.where(draw < int(min(1.0, max_rows / max(total, 1)) * (1 << 20)) + 1)
    moments = rows.agg(*(f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    if not total or moments[0] is None:
        return Model(np.zeros(d), np.ones(d))
    moments = np.array(moments, float).reshape(-1, 2)
    model = Model(moments[:, 0], np.maximum(moments[:, 1], 1e-6))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    hold = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0

    def parts(batches):
        size = FOURIER + 1
        sums = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = shared.value.map(_matrix(batch))
                y = batch.column("label").to_numpy(zero_copy_only=False)
                sums += z.T @ np.column_stack([z, y])
        if sums.any():
            at = np.arange(sums.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], ["at", "v"])

    entries = rows.where(~hold).select("stats", F.col("label").cast("double").alias("label")).mapInArrow(parts, "at int, v double")
    found = entries.groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    if len(found):
        sums = np.zeros((FOURIER + 1) * (FOURIER + 2))
        sums[found["at"]] = found["v"]
        sums = sums.reshape(FOURIER + 1, FOURIER + 2)
        ridge = RIDGE * sums[-1, -2] / FOURIER * np.eye(FOURIER + 1)
        ridge[-1, -1] = 1e-9
        model.weights = np.linalg.solve(sums[:, :-1] + ridge, sums[:, -1])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                raw = shared.value.raw(_matrix(batch))
                at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), batch.column("label")], ["at", "raw", "label"])

    # rows that were not fitted; all rows where there are none
    held = rows.where(hold)
    held = held if held.limit(1).count() else rows
    bins = (held.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(binned, "at int, raw double, label double")
            .groupBy("at").agg(F.avg("raw").alias("x"), F.sum("label").alias("s"), F.count("*").alias("n")).orderBy("at").toPandas())
    model.edges = np.maximum.accumulate(bins["x"].to_numpy())
    # one success and one failure spread over all rows keep the ends off 0 and 1
    model.levels = pooled(bins["s"].to_numpy(float) + 1 / len(bins), bins["n"].to_numpy(float) + 2 / len(bins))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score in 0..1) for every row of (doc_id, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = np.clip(shared.value.score(_matrix(batch)), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score) for every row of ``docs``.

    Labels (doc_id, quality 0/1) of documents for which the column ``learn_from`` holds are
    learned. Null labels and ids are left out; of several labels of a document the larger
    counts, and of several rows of a document the one with the least statistics is learned from.
    Null and empty texts are scored by the statistics of an empty text; texts of any length by
    those of the whole text; repeated rows each, equal texts alike; an empty table gives an
    empty result; other columns are ignored.
    """
    stats = stored(document_statistics(docs), "statistics")
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("label"))
    known = stats.where(learn_from).join(marked, "doc_id").groupBy("doc_id").agg(
        F.min("stats").alias("stats"), F.max("label").alias("label"))
    return score(stats, train(stored(known, "labelled"), max_rows))
