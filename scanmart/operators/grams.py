"""Terms found in texts by their rarest gram, in one pass over the texts and without shuffling them.

Texts and terms are compared as UTF-8 bytes; a gram is ``SIZE`` bytes of a text, or a whole shorter
term. Grams are numbers below ``CODES``, so what a task knows of them is bounded."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 3
#: First number of the grams of each size.
BASE = {3: 0, 2: 1 << 24, 1: (1 << 24) + (1 << 16)}
CODES = (1 << 24) + (1 << 16) + (1 << 8)
#: Bytes of text that a task looks through at a time, and rows that it holds before it hands them on.
SLICE_BYTES, HELD_ROWS = 2 << 20, 1 << 18


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary())


def _flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a column without nulls, one after the other, and where each value starts (and the last ends)."""
    column = _bytes(column)
    if not len(column):
        return b"", np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return data.to_pybytes()[ends[0]:ends[-1]] if data else b"", ends - ends[0]


def _text(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _grams(text: bytes, ends: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, numbers, rows) of all grams of the sizes that lie in one value."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    row = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    for size in sizes:
        n = len(b) - size + 1
        if n > 0:
            code = np.full(n, BASE[size], np.int32)
            for i in range(size):
                code += b[i:i + n] << (8 * (size - 1 - i))
            inside = row[:n] == row[size - 1:]
            yield size, code[inside], row[:n][inside]


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``SLICE_BYTES`` of ``column`` (one row at least)."""
    held, size = [], 0
    for batch in batches:
        start, ends = 0, np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - done)
            start = stop
            if size >= SLICE_BYTES or start < batch.num_rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n): the grams of the texts in ``_hay`` and how often each is in a slice of them."""
    for batch in slices(batches, "_hay"):
        for _, code, _ in _grams(*_flat(batch.column("_hay")), BASE):
            g, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(n, pa.int64())], ["g", "n"])


def spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, kind, g, grams): each gram of each term and how many different ones the term has."""
    for batch in slices(batches, "s"):
        text, ends = _flat(batch.column("s"))
        lengths, found = np.diff(ends), []
        for size, code, row in _grams(text, ends, BASE):
            whole = np.minimum(lengths[row], SIZE) == size
            found.append(np.unique(row[whole].astype(np.int64) * CODES + code[whole]))
        key = np.concatenate(found) if found else np.zeros(0, np.int64)
        row = key // CODES
        many = np.bincount(row, minlength=batch.num_rows)
        for a in range(0, len(key), HELD_ROWS):
            at = pa.array(row[a:a + HELD_ROWS])
            yield pa.RecordBatch.from_arrays([batch.column("s").take(at), batch.column("kind").take(at), pa.array((key % CODES)[a:a + HELD_ROWS], pa.int32()),
                                              pa.array(many[row[a:a + HELD_ROWS]], pa.int32())], ["s", "kind", "g", "grams"])


class Terms:
    """Terms by the number of the gram that they are looked up under, in flat buffers; kind ``d`` is sought at the start of a text."""

    def __init__(self, parts: list[pa.Array]):
        rows = pa.concat_arrays(parts)
        g = rows.field("g").to_numpy(zero_copy_only=False)
        order = np.argsort(g, kind="stable")
        self.text, ends = _flat(_bytes(rows.field("s")).take(pa.array(order)))
        self.ends = array("q", ends.tobytes())
        self.start_only = np.array([k == b"d" for k in rows.field("kind").cast(pa.binary()).to_pylist()], bool)[order].tobytes()
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = [*first.tolist(), len(g)]
        self.known = np.zeros(CODES, bool)
        self.known[self.grams] = True
        self.sizes = [s for s, a in BASE.items() if ((self.grams >= a) & (self.grams < a + (1 << 8 * s))).any()]


class Best:
    """For each term its first ``limit`` rows by (score desc, domain asc); what is handed on early leaves the worst of them as a mark."""

    def __init__(self, terms: Terms, limit: int):
        self.terms, self.limit, self.rows, self.marks, self.held = terms, limit, {}, {}, 0

    def look_through(self, batch: pa.RecordBatch) -> None:
        terms, limit, count = self.terms, self.limit, batch.num_rows
        text, ends = _flat(batch.column("_hay"))
        names = batch.column("domain").cast(pa.binary()).to_pylist()
        scores, starts = batch.column("_score").to_pylist(), batch.column("_n").to_pylist()
        # Spark's order: not-a-number is the largest score, null the smallest domain
        ranked = sorted((x == x, -x if x == x else 0.0, d is not None, d or b"", i) for i, (x, d) in enumerate(zip(scores, names)))
        order = [r[-1] for r in ranked]
        rank = np.empty(count, np.int64)
        rank[order] = np.arange(count)
        at = ends.tolist()
        texts, starts = [text[at[i]:at[i + 1]] for i in order], [starts[i] for i in order]
        keys = [np.searchsorted(terms.grams, code[hit]) * count + rank[row[hit]]
                for _, code, row in _grams(text, ends, terms.sizes) for hit in (terms.known[code],)]
        pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        gram, places = pairs // count, pairs % count
        for k in np.unique(gram).tolist():
            a, b = np.searchsorted(gram, [k, k + 1])
            group = places[a:b].tolist()
            for t in range(terms.first[k], terms.first[k + 1]):
                mark = self.marks.get(t)
                stop = count if mark is None else bisect_left(ranked, mark)
                if group[0] >= stop:
                    continue
                s, start_only, got = terms.text[terms.ends[t]:terms.ends[t + 1]], terms.start_only[t], []
                for r in group:
                    if r >= stop:
                        break
                    if texts[r].find(s, 0, starts[r]) >= 0 if start_only else s in texts[r]:
                        got.append(ranked[r][:4])
                        if len(got) == limit:
                            break
                if got:
                    old = self.rows.get(t, ())
                    new = self.rows[t] = sorted([*old, *got])[:limit]
                    self.held += len(new) - len(old)
                    if len(new) == limit:
                        self.marks[t] = new[-1]

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        terms, s, kind, domain, score = self.terms, [], [], [], []
        rows, self.rows, self.held = self.rows, {}, 0
        for t, found in rows.items():
            s += [terms.text[terms.ends[t]:terms.ends[t + 1]]] * len(found)
            kind += [b"d" if terms.start_only[t] else b"h"] * len(found)
            domain += [d if named else None for _, _, named, d in found]
            score += [-x if number else float("nan") for number, x, _, _ in found]
        if s:
            yield pa.RecordBatch.from_arrays([_text(s), _text(kind), _text(domain), pa.array(score, pa.float64())], ["s", "kind", "domain", "_score"])


def first_matches(limit: int):
    """A task's pass: rows with ``_terms`` bring the terms and come with the first text; the others are the texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, parts, early = iter(batches), [], []
        for batch in batches:
            listed = batch.column("_terms")
            parts += [listed[i].values for i in range(batch.num_rows) if listed[i].is_valid] if listed.null_count < len(listed) else []
            early.append(batch)
            if batch.num_rows and not batch.column("_first")[batch.num_rows - 1].as_py():
                break  # past the first text: all terms are there
        if not parts:
            return
        best = Best(Terms(parts), limit)

        def texts():
            for found in (early, batches):
                for batch in found:
                    yield batch.filter(batch.column("_terms").is_null()).select(["domain", "_score", "_n", "_hay"])

        for batch in slices(texts(), "_hay"):
            best.look_through(batch)
            if best.held >= HELD_ROWS:
                yield from best.handed_on()
        yield from best.handed_on()
    return run
