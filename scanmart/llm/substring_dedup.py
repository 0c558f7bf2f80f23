"""Exact substring dedup by seed and extend on winnowed anchors.

A window is ``length`` consecutive words. Its anchor is the smallest hash among its k-word
shingles (the rightmost of equals), so equal windows share their anchor at the same offset
(winnowing); neighbouring windows mostly share one, which makes one row per anchor and
place. Rows meet on the anchor and carry the hashes of the windows that extend it to both
sides; windows found twice there are the repeats, and the words under them, merged to
maximal spans, are the result.

A task first settles the repeats among its own words, so that a passage held by many
documents leaves it once. Anchors that still have many rows (short common phrases in ever
new surroundings) are counted beforehand; their windows meet on the window itself, which
spreads them. The list of such anchors is bounded (``HOT_LIST``, the most frequent ones)
and only says where rows meet, so the result does not depend on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key64, raw_texts, sliced, stored

SHINGLE = 8
#: Words that a task compares among themselves before it hands rows on.
BUFFER_WORDS = 3 << 19
#: Rows from which an anchor counts as hot, and the most hot anchors that are sent to tasks.
HOT_ROWS, HOT_LIST = 500, 1 << 20
#: Bytes of a window's hash kept beside its 64-bit anchor hash.
HASH_BYTES = 6

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _window_hashes(sums: np.ndarray, powers: np.ndarray, size: int) -> np.ndarray:
    """Hash of all windows of ``size`` words from the prefix sums: equal words, equal hash, whatever the place."""
    n = max(len(sums) - size, 0)
    return key64((sums[size:] - sums[:n]) * powers[:n])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbouring values, the rightmost of equals."""
    best, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        take = right <= left
        best, at, have = np.where(take, right, left), np.where(take, at[step:], at[:-step]), have + step
    return at


def _buffers(batches, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, ends, word hashes) of rows of ``length`` words or more, about BUFFER_WORDS words at a time."""
    hashes, keys, parts, count = _WordHashes(), [], [], 0
    for part in sliced(batches):
        for key, text in zip(part.column("rk").to_pylist(), raw_texts(part)):
            words = (text or b"").split()
            if len(words) < length:
                continue
            keys.append(key)
            parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            count += len(words)
            if count >= BUFFER_WORDS:
                yield np.array(keys, np.int64), np.cumsum([len(x) for x in parts]), np.concatenate(parts)
                keys, parts, count = [], [], 0
    if parts:
        yield np.array(keys, np.int64), np.cumsum([len(x) for x in parts]), np.concatenate(parts)


def _windows(ends: np.ndarray, words: np.ndarray, length: int, shingle: int):
    """(row, place in the buffer, hash, anchor's place, anchor's hash) of every window."""
    powers = _powers(_BASE, len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(_INVERSE, len(words)), dtype=np.uint64)])
    grams = _window_hashes(sums, powers, shingle)
    whole = _window_hashes(sums, powers, length)
    anchor = _smallest(grams, length - shingle + 1)
    starts = np.concatenate([[0], ends[:-1]])
    counts = ends - starts - length + 1
    row = np.repeat(np.arange(len(ends)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[row]
    return row, place, whole[place], anchor[place], grams[anchor[place]]


def _merged(row: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of the maximal spans under windows sorted by place."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], place[first], place[last] + length


def _anchor_counts(length: int, shingle: int):
    def run(batches):
        for _, ends, words in _buffers(batches, length):
            _, _, _, at, anchor = _windows(ends, words, length, shingle)
            own = np.ones(len(at), bool)
            own[1:] = at[1:] != at[:-1]
            found, n = np.unique(anchor[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _anchor_rows(length: int, shingle: int, hot_list):
    """Rows (key, rk, place, mask, stop, hashes): an anchor's windows, or a span settled here (stop > 0)."""

    def run(batches):
        hot = hot_list.value
        for keys, ends, words in _buffers(batches, length):
            starts = np.concatenate([[0], ends[:-1]])
            row, place, whole, at, anchor = _windows(ends, words, length, shingle)
            order = np.argsort(whole, kind="stable")
            again = np.zeros(len(order), bool)
            again[1:] = whole[order[1:]] == whole[order[:-1]]
            later, repeated = np.zeros(len(order), bool), np.zeros(len(order), bool)
            later[order], repeated[order] = again, again | np.append(again[1:], False)
            if repeated.any():
                r, a, b = _merged(row[repeated], place[repeated], length)
                yield _rows(keys[r], keys[r], a - starts[r], np.zeros(len(r), np.int64), b - starts[r], np.zeros((len(r), 0), np.uint8), 0)
            row, place, whole, at, anchor = (x[~later] for x in (row, place, whole, at, anchor))
            spread = np.zeros(len(row), bool)
            if len(hot):
                spread = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
            new = np.ones(len(row), bool)
            new[1:] = (at[1:] != at[:-1]) | spread[1:]
            first = np.flatnonzero(new)
            if not len(first):
                continue
            base = place[first]
            bit = np.uint64(1) << (place - np.repeat(base, np.diff(np.append(first, len(row))))).astype(np.uint64)
            mask = np.bitwise_or.reduceat(bit, first).view(np.int64)
            key = np.where(spread, whole, anchor)[first].view(np.int64)
            small = whole.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
            yield _rows(key, keys[row[first]], base - starts[row[first]], mask, np.zeros(len(first), np.int64), small, first)

    return run


def _rows(key, rk, place, mask, stop, small, first) -> pa.RecordBatch:
    offsets = np.append(first, len(small)) if small.shape[1] else np.zeros(len(key) + 1)
    offsets = pa.py_buffer((offsets * HASH_BYTES).astype(np.int32))
    blob = pa.Array.from_buffers(pa.binary(), len(key), [None, offsets, pa.py_buffer(np.ascontiguousarray(small))])
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(rk), pa.array(place.astype(np.int32)), pa.array(mask), pa.array(stop.astype(np.int32)), blob],
        ["key", "rk", "place", "mask", "stop", "hashes"])


#: Rows of one key that a task holds before it settles them and keeps one for each window.
HELD_ROWS = 1 << 14


def _repeats(length: int):
    """Spans (rk, a, b) of the windows found twice at their key; rows come sorted by key.

    Of a key with very many rows only its different windows are held."""

    def settle(rows: pa.Table):
        key, rk, place, mask, stop = (rows.column(i).to_numpy() for i in range(5))
        done = stop > 0
        if done.any():
            yield rk[done], place[done], stop[done]
        many = ~done
        same = (key[1:] == key[:-1]) & many[1:] & many[:-1]
        many &= np.append(same, False) | np.append(False, same)
        if not many.any():
            return
        rows = rows.filter(pa.array(many)).combine_chunks()
        key, rk, place, mask = key[many], rk[many], place[many], mask[many].view(np.uint64)
        blob = rows.column("hashes").to_pylist()
        raw = np.frombuffer(b"".join(blob), np.uint8).reshape(-1, HASH_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :HASH_BYTES] = raw
        whole = wide.view(np.uint64)[:, 0]
        owner = np.repeat(np.arange(len(key)), np.bitwise_count(mask).astype(np.int64))
        bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        offset = np.nonzero(bits)[1]
        group = np.cumsum(np.append(True, key[1:] != key[:-1]))[owner]
        order = np.lexsort((whole, group))
        same = (whole[order[1:]] == whole[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        found = np.zeros(len(order), bool)
        found[order] = np.append(same, False) | np.append(False, same)
        if found.any():
            own, at = owner[found], (place[owner] + offset)[found]
            r, a, b = _merged(own, at, length)
            yield rk[r], a, b

    def run(batches):
        held, enough = None, HELD_ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            key = rows.column("key").to_numpy()
            split = int(np.searchsorted(key, key[-1]))
            held = rows.slice(split).combine_chunks()
            for r, a, b in settle(rows.slice(0, split)) if split else ():
                yield _spans(r, a, b)
            enough = HELD_ROWS if split else enough
            if held.num_rows > enough:  # a key that goes on and on: what it has twice is known now
                for r, a, b in settle(held):
                    yield _spans(r, a, b)
                held = _one_of_each_window(held)
                enough = max(HELD_ROWS, 2 * held.num_rows)
        for r, a, b in settle(held) if held is not None else ():
            yield _spans(r, a, b)

    return run


def _one_of_each_window(rows: pa.Table) -> pa.Table:
    """A row for each different window of rows of one key: enough to tell later rows that have it.

    Spans that its rows had are out already, and may come once more."""
    open_rows = rows.filter(pc.equal(rows.column("stop"), 0)).combine_chunks()
    key, rk, place, mask = (open_rows.column(c).to_numpy() for c in ("key", "rk", "place", "mask"))
    mask = mask.view(np.uint64)
    owner = np.repeat(np.arange(len(key)), np.bitwise_count(mask).astype(np.int64))
    offset = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))[1]
    raw = np.frombuffer(b"".join(open_rows.column("hashes").to_pylist()), np.uint8).reshape(-1, HASH_BYTES)
    _, first = np.unique(raw, axis=0, return_index=True)
    own = owner[first]
    batch = _rows(key[own], rk[own], place[own] + offset[first], np.ones(len(own), np.int64), np.zeros(len(own), np.int64), raw[first], np.arange(len(own)))
    return pa.Table.from_batches([batch]).cast(rows.schema)


def _spans(rk, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rk), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["rk", "a", "b"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their id and text: equal rows have equal results, so they may share it."""
    text = F.col("text").cast("string").alias("text")
    return docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), text)


def repeated_spans(docs: DataFrame, length: int = 35, shingle: int = SHINGLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rk, spans): word spans [a, b) under repeated windows; rk is a hash of doc_id and text.

    Spans of a row may overlap. ``shingle`` < ``length`` < ``shingle`` + 63.
    """
    texts = _keyed(docs).select("rk", "text")
    counts = texts.mapInArrow(_anchor_counts(length, shingle), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    hot = stored(counts.where(F.col("n") > hot_rows), "hot-anchors")
    if hot.count() > HOT_LIST:
        hot = hot.orderBy(F.col("n").desc(), "anchor").limit(HOT_LIST)
    listed = np.sort(np.array([r[0] for r in hot.select("anchor").collect()], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(listed)
    rows = texts.mapInArrow(
        _anchor_rows(length, shingle, shared), "key long, rk long, place int, mask long, stop int, hashes binary")
    spans = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_repeats(length), "rk long, a int, b int")
    return spans.distinct().groupBy("rk").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _covered(n: int, spans) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, [s["a"] for s in spans], 1)
    np.add.at(depth, [s["b"] for s in spans], -1)
    return np.cumsum(depth[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = 35, shingle: int = SHINGLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): each row's text without the words under repeated windows.

    ``kept`` has the other words joined by one space. A window that starts anywhere else,
    in the same row or another, is repeated, so all its occurrences go. Null, empty and
    short texts lose nothing; repeated rows of ``length`` words or more lose everything; an
    empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_spans(docs, length, shingle, hot_rows)

    def run(batches):
        for part in sliced(batches):
            out = []
            for text, own in zip(raw_texts(part), part.column("spans").to_pylist()):
                words = (text or b"").split()
                rest = words
                if own:
                    gone = _covered(len(words), own)
                    rest = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(rest)
                out.append((len(words), len(words) - len(rest), hashlib.sha256(kept).hexdigest(), kept.decode()))
            n, removed, sha, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return _keyed(docs).join(spans, "rk", "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
