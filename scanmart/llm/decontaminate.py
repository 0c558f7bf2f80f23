"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are cut into lower-case words. Runs of ``min_tile`` words that
both have (a Karp-Rabin hash over word numbers) are seeds; an item whose seeds in a document
could cover enough of it is tiled: the longest match without marked words is marked again and
again until none of ``min_tile`` words is left. The share of the item's words under tiles
is its coverage, which does not depend on the order of the passages. Items of fewer words
hold no seed; with ``short_items`` they are found where they stand whole.

The longest match is sought by its length, with running hashes of the unmarked windows of a
length on either side, so that pairs of places are never listed: time and memory follow the
words of the text and the item, also where one word is repeated throughout.

The benchmark is the stated query set. It is dealt into blocks of bounded size, and each
block is broadcast for one narrow pass over all documents: nothing is shuffled and no
document text moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key64, sliced

MIN_TILE = 5
COVERAGE = 0.5
#: Characters of benchmark text in one broadcast block, on average.
BLOCK_CHARS = 8 << 20

_SPLIT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all other non-ASCII characters."""
    return (text or "").lower().encode().translate(_SPLIT).split()


class Items(dict):
    """A block of benchmark items: word numbers (0: unknown) and the sorted seeds with their places."""

    def __missing__(self, word: bytes) -> int:
        return 0

    def __init__(self, rows: list[tuple[int, str]], size: int = 0, short_items: bool = False):
        super().__init__()
        if not size:
            return
        self.size, self.ids, self.words, self.short, short = size, [], [], {}, []
        for item_id, text in rows:
            numbers = [self.setdefault(w, len(self) + 1) for w in tokens(text)]
            if len(numbers) >= size:
                self.ids.append(item_id)
                self.words.append(np.array(numbers, np.uint64))
            elif numbers and short_items:
                short.append((item_id, tuple(numbers)))
        hashes = [rolling(w, size) for w in self.words]
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        seed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order], at[order]
        # by number of words: the short items, each with its indexes
        for item_id, numbers in short:
            self.short.setdefault(len(numbers), {}).setdefault(numbers, []).append(len(self.ids))
            self.ids.append(item_id)
        self.short = {n: (np.concatenate([rolling(np.array(x, np.uint64), n) for x in own]), own) for n, own in self.short.items()}

    def __reduce__(self):
        return _restored, (dict(self), self.__dict__)


def _restored(words: dict, state: dict) -> Items:
    out = Items([])
    out.update(words)
    out.__dict__.update(state)
    return out


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        out = out * _BASE + words[j:j + n]
    return out


class Running:
    """Karp-Rabin hashes of the unmarked windows of any length of a row of words."""

    def __init__(self, words: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words), bool)
        odd = np.uint64(int(_BASE) | 1)
        powers = np.full(len(words) + 1, odd)
        powers[0] = 1
        back = np.full(len(words) + 1, np.uint64(pow(int(odd), -1, 1 << 64)))
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(key64(words) * np.cumprod(powers)[:-1])])
        self.settle()

    def settle(self) -> None:
        """Takes the marks made since into account."""
        self.before = np.concatenate([[0], np.cumsum(self.marked)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of ``n`` words that had no mark when last settled."""
        starts = np.flatnonzero(self.before[n:] == self.before[:-n]) if n <= len(self.words) else np.zeros(0, np.int64)
        return starts, (self.sums[starts + n] - self.sums[starts]) * self.back[starts]


def tiles(doc: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(document place, item place, words) of the greedy tiles: the longest first, of equal ones the first in the item."""
    left, right, out = Running(doc), Running(item), []
    most = min(len(doc), len(item))
    while most >= size:
        low, high = size - 1, most  # a match of ``low`` words is known, of more than ``high`` there is none
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(right.windows(n)[1], left.windows(n)[1]).any():
                low = n
            else:
                high = n - 1
        if low < size:
            break
        out += _marked(left, right, low)
        most = low - 1
    return out


def _marked(left: Running, right: Running, n: int) -> list[tuple[int, int, int]]:
    """Marks the matches of ``n`` words, none of which is longer: by item place, each at the first free document place."""
    (starts, hashes), (places, wanted) = left.windows(n), right.windows(n)
    there = np.isin(wanted, hashes)
    places, wanted = places[there], wanted[there]
    order = np.argsort(hashes, kind="stable")
    starts, hashes = starts[order], hashes[order]
    first = dict(zip(np.unique(wanted).tolist(), np.searchsorted(hashes, np.unique(wanted)).tolist()))
    last = dict(zip(np.unique(wanted).tolist(), np.searchsorted(hashes, np.unique(wanted), side="right").tolist()))
    out, free = [], 0
    for j, h in zip(places.tolist(), wanted.tolist()):
        if j < free:
            continue
        k = first[h]
        # marks made in this round are as long as the window: one that overlaps it covers one of its ends
        while k < last[h] and (left.marked[starts[k]] or left.marked[starts[k] + n - 1]):
            k += 1
        first[h] = k
        for i in starts[k:last[h]].tolist():
            if not left.marked[i] and not left.marked[i + n - 1] and (left.words[i:i + n] == right.words[j:j + n]).all():
                left.marked[i:i + n] = right.marked[j:j + n] = True
                out.append((i, j, n))
                free = j + n
                break
    left.settle()
    right.settle()
    return out


def _covered(places: np.ndarray, size: int) -> int:
    """The words under runs of ``size`` from the sorted ``places``."""
    return int(np.minimum(np.diff(places), size).sum()) + size


def _runs(doc: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The words under runs of ``size`` from the sorted ``places``, with a word that no item has between separate runs."""
    under = np.zeros(len(doc) + 1, np.int64)
    np.add.at(under, places, 1)
    np.add.at(under, np.minimum(places + size, len(doc)), -1)
    at = np.flatnonzero(np.cumsum(under)[:-1])
    return np.insert(doc[at], np.flatnonzero(np.diff(at) > 1) + 1, np.uint64(0))


def found_in(text: str | None, items: Items, coverage: float = 0.0) -> Iterator[tuple[int, float, int, int]]:
    """(item index, coverage, tiles, longest tile) for each item that shares a seed with the text or, if short, is in it.

    Items that cannot reach ``coverage`` may be left out."""
    words = tokens(text)
    long = len(words) >= items.size and len(items.seed) > 0
    if not long and not items.short:
        return
    doc = np.fromiter(map(items.__getitem__, words), np.uint64, len(words))
    for n, (hashes, own) in items.short.items():
        for window in {tuple(doc[i:i + n].tolist()) for i in np.flatnonzero(np.isin(rolling(doc, n), hashes)).tolist()}:
            yield from ((k, 1.0, 1, n) for k in own.get(window, ()))
    if not long:
        return
    unknown = np.concatenate([[0], np.cumsum(doc == 0)])
    places = np.flatnonzero(unknown[items.size:] == unknown[:-items.size])
    hashes = rolling(doc, items.size)[places]
    # the seeds that the text has, each once, and where items have them
    distinct = np.unique(hashes)
    low = np.searchsorted(items.seed, distinct)
    many = np.searchsorted(items.seed, distinct, side="right") - low
    if not many.any():
        return
    kept = np.isin(hashes, distinct[many > 0])
    places, hashes = places[kept], hashes[kept]
    seeds = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, to, seed = items.item[seeds], items.at[seeds], items.seed[seeds]
    order = np.lexsort((to, item))
    item, to, seed = item[order], to[order], seed[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(item) != 0])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)]):
        k = int(item[a])
        total = len(items.words[k])
        if _covered(to[a:b], items.size) < coverage * total:
            continue
        own = places[np.isin(hashes, seed[a:b])]
        marked = tiles(_runs(doc, own, items.size), items.words[k], items.size)
        if marked:
            yield k, sum(n for _, _, n in marked) / total, len(marked), max(n for _, _, n in marked)


def _blocks(benchmark: DataFrame, min_tile: int, block_chars: int, short_items: bool) -> Iterator:
    """The benchmark in broadcast blocks; an item is in one block."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    for b in range(count):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == b).collect()
        yield rows.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in block], min_tile, short_items))


def matches(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE,
            block_chars: int = BLOCK_CHARS, short_items: bool = False) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest): the items of which a document covers ``coverage`` or more.

    Null and empty texts match nothing; texts of any length are taken whole. Items of fewer than
    ``min_tile`` words match where all of their words stand in a row, if ``short_items``, else
    nothing. Of equally long tiles the first in the item is marked, at the first free place in
    the document. Repeated rows and repeated items are reported each; empty tables give no rows.
    Other columns are ignored.
    """
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest int"

    def scan(items):
        def run(batches):
            block = items.value
            for part in sliced(batches):
                ids = part.column("doc_id").to_pylist()
                rows = [(doc_id, block.ids[k], c, n, longest) for doc_id, t in zip(ids, part.column("text").to_pylist())
                        for k, c, n, longest in found_in(t, block, coverage) if c >= coverage]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows), types)],
                        ["doc_id", "item_id", "coverage", "n_tiles", "longest"])
        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, min_tile, block_chars, short_items):
        found = texts.mapInArrow(scan(items), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE,
          block_chars: int = BLOCK_CHARS, short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item to ``coverage``; columns are those of ``docs``.

    Null and empty texts stay, repeated rows stay or go together; else as in ``matches``."""

    def keep(items):
        def run(batches):
            block = items.value
            for part in sliced(batches):
                free = [all(c < coverage for _, c, _, _ in found_in(t, block, coverage)) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(free))
        return run

    for items in _blocks(benchmark, min_tile, block_chars, short_items):
        docs = docs.mapInArrow(keep(items), docs.schema)
    return docs
