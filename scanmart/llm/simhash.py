"""SimHash near-duplicates by anchor-point covering.

Fingerprints of at most ``max_bits`` differing bits are linked. The 64 bits are cut into
blocks that may differ in t_1, t_2, ... bits with sum(t_i + 1) = max_bits + 1, so a linked
pair agrees within t_i in one block at least. In each block the anchors are the words of
perfect covering codes (Hamming codes on the first bits, all words on the rest; covering
radius R, 1 for each code). A fingerprint's home is its one anchor within 1 of each code; it is
replicated to the home of every word within t_i of it, anchors within R + t_i. A linked pair
therefore meets at the home of either side, and there homes are compared with all replicas by
bit count.

The blocks follow the number of distinct fingerprints. Three blocks have 2 ** 18 anchors at
most; from ``WIDE_FROM`` on two blocks of 32 bits and two codes have 2 ** 24, with more replicas
a fingerprint and fewer comparisons an anchor.

Only distinct fingerprints enter, so exact copies cost one row. An anchor's comparison
emits a spanning forest of its links, never all pairs. Anchors with more homes than
``hot_homes`` are split into slices of homes that are compared in separate tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, raw_texts, sliced, stored
from .components import component_labels

BITS = 64
SEED = 42
#: Hashes whose bits are counted at a time.
COUNT_ROWS = 1 << 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text's word shingles, repeats included (no words: 0)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    for at in range(0, n, COUNT_ROWS):
        spans = zip(starts[at:min(at + COUNT_ROWS, n)].tolist(), last[at:at + COUNT_ROWS].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long: the 64 bits, signed) and the long columns ``carry`` for every row; null texts count as empty."""

    def run(batches):
        for part in sliced(batches):
            fps = np.array([fingerprint(t, shingle) for t in raw_texts(part)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(fps), *map(part.column, carry)], ["doc_id", "fp", *carry])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in carry)]))


#: Distinct fingerprints from which two wide blocks are used: about where 130 more replicas a fingerprint to shuffle cost
#: what comparisons at 2 ns each save (three blocks: 30 replicas, 1.3e-4 n ** 2 comparisons; wide: 159, 9.5e-6 n ** 2).
WIDE_FROM = 1 << 28


def _blocks(max_bits: int, wide: bool = False) -> list[tuple[int, int, int, int]]:
    """(first bit, width, bits that may differ, Hamming codes) for each block: at most three, or two wide ones."""
    count = min(2 if wide else 3, max_bits + 1)
    shares = [(max_bits + 1) // count + (i < (max_bits + 1) % count) for i in range(count)]
    widths = [BITS // count + (i < BITS % count) for i in range(count)]
    if count == 3:
        widths = [22, 22, 20]
    starts = np.cumsum([0, *widths[:-1]]).tolist()
    return [(s, w, share - 1, 2 if wide and w >= 30 else 1) for s, w, share in zip(starts, widths, shares)]


def _homes(words: np.ndarray, width: int, codes: int = 1) -> np.ndarray:
    """The anchor nearest to each word: in each code the Hamming syndrome names the bit to flip, if any."""
    r = 4 if width >= 15 * codes else 3 if width >= 7 else 2 if width >= 3 else 0
    out = words.copy()
    for code in range(codes):
        first = ((1 << r) - 1) * code
        syndrome = np.zeros(words.shape, np.uint64)
        for j in range(r):
            mask = np.uint64(sum(1 << (first + i - 1) for i in range(1, 1 << r) if i >> j & 1))
            syndrome |= (np.bitwise_count(words & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
        hit = syndrome > 0
        out[hit] ^= np.uint64(1) << (np.uint64(first) + syndrome[hit] - np.uint64(1))
    return out


def _replicas(fps: np.ndarray, max_bits: int, wide: bool = False):
    """(key, role, fp) arrays: role 0 at the home anchor, role 1 at the home of every word within t."""
    for b, (first, width, t, codes) in enumerate(_blocks(max_bits, wide)):
        words = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        flips = np.array([sum(1 << i for i in c) for n in range(t + 1) for c in combinations(range(width), n)], np.uint64)
        near = np.sort(_homes(words[:, None] ^ flips[None, :], width, codes), axis=1)
        first_of = np.ones(near.shape, bool)
        first_of[:, 1:] = near[:, 1:] != near[:, :-1]
        row, _ = np.nonzero(first_of)
        tag = np.uint64(b) << np.uint64(60)
        yield _homes(words, width, codes) | tag, 0, fps
        yield near[first_of] | tag, 1, fps[row]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) as (larger, smallest of its component)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compared(max_bits: int, pairs_at_once: int = 1 << 21):
    """Links at each anchor: rows come sorted by (key, slice, role), homes before replicas."""

    def run(batches):
        held = None  # the homes of the group that may go on in the next batch
        for batch in batches:
            key, part, role, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if held is not None:
                key, part, role, fp = (np.concatenate(x) for x in zip(held, (key, part, role, fp)))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            homes = np.bincount(group, weights=role == 0, minlength=len(begin)).astype(np.int64)
            last = slice(begin[-1], begin[-1] + homes[-1])
            held = tuple(x[last].copy() for x in (key, part, role, fp))
            member = np.flatnonzero((role == 1) & (homes[group] > 0))
            load = np.cumsum(homes[group[member]])
            at = 0
            while at < len(member):
                done = load[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(load, done + pairs_at_once, side="right")))
                some = member[at:stop]
                reps = homes[group[some]]
                right = np.repeat(some, reps)
                offset = np.arange(len(right)) - np.repeat(np.cumsum(reps) - reps, reps)
                left = begin[group[right]] + offset
                x, y = fp[left], fp[right]
                near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits)
                if near.any():
                    u, v = _forest(x[near], y[near])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                at = stop

    return run


def links(distinct: DataFrame, max_bits: int, hot_homes: int = 1 << 15, wide_from: int = WIDE_FROM) -> DataFrame:
    """Spanning links (u > v) between the distinct fingerprints of ``distinct`` (fp long)."""
    wide = distinct.count() >= wide_from
    rows_at_once = 1 << 11 if wide else 1 << 14

    def expand(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                fps = batch.column(0).slice(at, rows_at_once).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for key, role, fp in _replicas(fps, max_bits, wide):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(key), role, np.int8)), pa.array(fp.view(np.int64))],
                        ["key", "role", "fp"],
                    )

    rows = distinct.select("fp").mapInArrow(expand, "key long, role byte, fp long")
    hot = stored(rows.where("role = 0").groupBy("key").count().where(F.col("count") > hot_homes), "hot-anchors")
    if hot.limit(1).count():
        # homes are dealt to slices; replicas go to every slice of their anchor
        rows = rows.join(hot, "key", "left").withColumn("slices", F.coalesce(F.ceil(F.col("count") / hot_homes), F.lit(1)))
        rows = rows.withColumn(
            "part",
            F.explode(F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("slices")))).otherwise(
                F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))),
        )
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    rows = rows.select("key", F.col("part").cast("int").alias("part"), "role", "fp")
    return (
        rows.repartition("key", "part").sortWithinPartitions("key", "part", "role")
        .mapInArrow(_compared(max_bits), "u long, v long").distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 4, hot_homes: int = 1 << 15,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (doc_id, fp, label, component_id) and the long columns ``carry``.

    ``label`` is the smallest fingerprint (as a signed long) of the row's component and
    ``component_id`` the smallest doc_id in it (null if none of its rows has one). Null and
    empty texts have fingerprint 0 and are linked like any other. Repeated rows stay. An
    empty table gives an empty result; other columns are ignored.
    """
    fps = stored(fingerprints(docs, shingle, carry=carry), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "classes")
    labels = component_labels(links(classes, max_bits, hot_homes))
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "rows", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "labels")
    # a text with very many copies, or a component of very many texts, is not brought to one task
    ids = stored(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("texts"), F.sum("rows").alias("all")), "ids")
    texts, rows = ids.agg(F.sum("texts"), F.sum("all")).first()
    known = stored(hot_join(named.select("fp", "rows", "label"), ids.drop("all"), "label", "texts", texts or 0), "known")
    return hot_join(fps, known, "fp", "rows", rows or 0).select("doc_id", "fp", "label", "component_id", *carry)


def hex_digits(fp):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each_group(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicates.

    The row with the group's smallest doc_id stays; of equal ids the one with the smallest
    text hash, of equal texts that with the smallest hash of all columns. Rows without an id
    yield to rows with one; a group without any id keeps one row. Columns are those of ``docs``.

    A row is known by its two hashes, not by its id, which rows of other groups may have too.
    """
    key = ("_text", "_row")
    keyed = docs.withColumn("_text", F.xxhash64("text")).withColumn(
        "_row", F.xxhash64(*(x for c in docs.columns for x in (F.col(c), F.col(c).isNull()))))
    found = near_duplicates(keyed, shingle, max_bits, carry=key)
    heads = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key)).alias("head"))
    heads = stored(heads.select(*(f"head.{c}" for c in key)), "heads")
    return keyed.join(heads, [*key], "left_semi").dropDuplicates([*key]).select(*docs.columns)
