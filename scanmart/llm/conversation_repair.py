"""Conversation structure repair by depth-first branch-and-bound.

A conversation's turns shall be, by the first letters of their roles, ``s`` or nothing, then
``ua`` once or more; or nothing at all. Turns may be kept, given another role, deleted, or new
empty ones inserted, each at its cost; of the cheapest repairs the one with the ASCII-least
audit (the initials of its edits in order) is taken.

The search goes through a conversation in blocks of rows. In a block a node is a place and the
last role so far; an explicit stack of partial edits is followed depth first, the bound of a
node is the least cost of the rest of the block, and a prefix is dropped if its cost and that
bound exceed the incumbent's or if the node's dominance table has a better (cost, audit). What
leaves a block are at most four prefixes, one for each last role, so a conversation of any
length takes one pass, and between blocks only the order of these prefixes is kept, not their
text. Audits are linked lists of block parts.

Only letters and flags of turns go through the search; texts are shuffled once, to be hashed
with the audit at hand, a turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Last role so far: none, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Where a user or assistant turn, whichever is due, leads.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What a conversation may end with.
WHOLE = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
BLOCK_ROWS = 64
NO_WAY = 1 << 60
#: A fault of a turn: its first one counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)


def kept_as(letter: str, state: int) -> int | None:
    """Where keeping a turn of this initial leads from ``state``; None if the pattern forbids it."""
    if letter == "s":
        return SYSTEM if state == START else None
    if letter == "u":
        return None if state == USER else USER
    return ASSISTANT if letter == "a" and state == USER else None


def row_edits(letter: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn, by falling ASCII order of the edits."""
    if fault in (BLANK, DUPLICATE):
        return [(DELETE, DELETE_COST, state)]
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    out = [(REROLE, REROLE_COST + more, DUE[state])]
    if (to := kept_as(letter, state)) is not None:
        out.append((KEEP, more, to))
    return [*out, (DELETE, DELETE_COST, state)]


class Costs(dict):
    """(initial, fault) -> least cost from each state before a turn to each state after it, inserts before it included."""

    def __missing__(self, row: tuple[str, int]) -> list[list[int]]:
        plain = [[min((c for _, c, to in row_edits(*row, s) if to == t), default=NO_WAY) for t in STATES] for s in STATES]
        one, two = DUE, {s: DUE[DUE[s]] for s in STATES}
        self[row] = [[min(plain[s][t], INSERT_COST + plain[one[s]][t], 2 * INSERT_COST + plain[two[s]][t]) for t in STATES]
                     for s in STATES]
        return self[row]


COSTS = Costs()


def bounds(rows: list[tuple[str, int]]) -> list[list[list[int]]]:
    """For each place and state, the least cost to each state at the end of the rows."""
    out = [[[0 if s == t else NO_WAY for t in STATES] for s in STATES]]
    for row in reversed(rows):
        step, rest = COSTS[row], out[-1]
        out.append([[min(step[s][m] + rest[m][t] for m in STATES) for t in STATES] for s in STATES])
    return out[::-1]


def searched(rows: list[tuple[str, int]], entries: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str, int]]:
    """The least (cost, audit) with which each state is reached at the end of ``rows``, and the entry it came from.

    entries: state -> (cost, audit so far). An audit in the result starts with its entry's."""
    bound = bounds(rows)
    # incumbents: their cost is known from the bounds at the entries, their audit not yet
    best = {t: (least, None, None) for t in STATES
            if (least := min((c + bound[0][s][t] for s, (c, _) in entries.items()), default=NO_WAY)) < NO_WAY}
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, s, c, text, s) for s, (c, text) in sorted(entries.items(), key=lambda e: e[1][1], reverse=True)]
    while stack:
        at, state, cost, audit, origin = stack.pop()
        if table.get((at, state), (NO_WAY, "")) <= (cost, audit):
            continue  # dominated at this node
        rest = bound[at][state]
        if not any(cost + rest[t] < c or cost + rest[t] == c and (a is None or audit < a) for t, (c, a, _) in best.items()):
            continue  # no incumbent can be bettered
        table[at, state] = cost, audit
        if at == len(rows):
            best[state] = cost, audit, origin
            continue
        for edit, more, to in row_edits(*rows[at], state):
            if edit in (REROLE, KEEP):
                stack.append((at + 1, to, cost + more, audit + edit, origin))
        stack.append((at, DUE[state], cost + INSERT_COST, audit + INSERT, origin))
        stack.append((at + 1, state, cost + DELETE_COST, audit + DELETE, origin))
    return best


def short_keys(texts: dict[int, str]) -> dict[int, str]:
    """Strings that compare as ``texts`` do, whatever follows: a rank, and what exceeds a prefix that is a text too."""
    out, base, rank = {}, None, 0
    for state, text in sorted(texts.items(), key=lambda x: x[1]):
        if base is not None and text.startswith(texts[base]):
            out[state] = out[base] + text[len(texts[base]):]
        else:
            base, rank = state, rank + 1
            out[state] = chr(rank)
    return out


class Repair:
    """The cheapest edits of one conversation whose turns are added one by one."""

    def __init__(self):
        self.rows: list[tuple[str, int]] = []
        # state -> (cost, key, linked audit parts)
        self.front: dict[int, tuple[int, str, tuple | None]] = {START: (0, "\x01", None)}

    def add(self, letter: str, fault: int) -> None:
        self.rows.append((letter, fault))
        if len(self.rows) == BLOCK_ROWS:
            self._close()

    def _close(self) -> None:
        found = searched(self.rows, {s: (c, k) for s, (c, k, _) in self.front.items()})
        keys = short_keys({t: audit for t, (_, audit, _) in found.items()})
        self.front = {t: (c, keys[t], (self.front[s][2], audit[len(self.front[s][1]):])) for t, (c, audit, s) in found.items()}
        self.rows = []

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the whole conversation."""
        self._close()
        ends = []
        for state, (cost, key, parts) in self.front.items():
            inserts = 0
            while state not in WHOLE:
                state, inserts = DUE[state], inserts + 1
            ends.append((cost + INSERT_COST * inserts, key + INSERT * inserts, INSERT * inserts, parts))
        cost, _, tail, parts = min(ends, key=lambda e: e[:2])
        out = [tail]
        while parts:
            parts, text = parts
            out.append(text)
        return cost, "".join(reversed(out))


def _wrapped(n: int) -> int:
    """As a signed 64-bit number."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


class Conversation:
    """Counts and repair of the turns of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.repair, self.last, self.before, self.low, self.high = conv_id, Repair(), None, None, None, None
        self.turns = self.illegal = 0
        self.faults = [0] * 4

    def add(self, turn, role: str, digest: str, blank: bool, truncated: bool, seen: bool) -> None:
        row = (turn, role, digest)
        if turn is not None and (self.last is None or self.last[0] != turn):
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        fault = BLANK if blank else DUPLICATE if seen or row == self.last else TRUNCATED if truncated else NONE
        self.faults[fault] += 1
        letter = role[:1]
        self.illegal += self.last is not None and self.before + letter not in LEGAL_PAIRS
        self.last, self.before = row, letter
        self.repair.add(letter, fault)

    def result(self) -> tuple:
        cost, audit = self.repair.result()
        gaps = 0 if self.low is None else _wrapped(self.high - self.low + 1 - self.turns)
        return self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _planned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; rows come sorted by conversation, turn, role and digest."""
    types, names = [pa.int64()] * 7 + [pa.string()], ["conv_id", *COUNTS, "audit"]
    now: Conversation | None = None
    for batch in batches:
        done = []
        for conv_id, turn, role, digest, blank, truncated, seen, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            for _ in range(copies):
                now.add(turn, role, digest, blank, truncated, seen)
        if done:
            yield _batch(done, types, names)
    if now is not None:
        yield _batch([now.result()], types, names)


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each repaired conversation; an audit comes before its conversation's turns, which are sorted as before."""
    types, names = [pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()], ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    now = None

    def inserted(state, at):
        while at < len(audit) and audit[at] == INSERT:
            state, at = DUE[state], at + 1
            put("user:" if state == USER else "assistant:")
        return state, at

    def put(text):
        nonlocal first
        sha.update(text.encode() if first else b"\n" + text.encode())
        first = False

    for part in sliced(batches):
        done = []
        for row in zip(*(c.to_pylist() for c in part.columns)):
            conv_id, counts, role, text, copies = row[0], row[1:8], row[8], row[9], row[10]
            if counts[-1] is not None:  # an audit
                if now is not None:
                    inserted(state, at)
                    done.append((*now, sha.hexdigest()))
                now, audit, sha, first, state, at = (conv_id, *counts), counts[-1], hashlib.sha256(), True, START, 0
                continue
            for _ in range(copies):
                state, at = inserted(state, at)
                edit, at = audit[at], at + 1
                if edit == KEEP:
                    state = kept_as(role[:1], state)
                    put(f"{role}:{text}")
                elif edit == REROLE:
                    state = DUE[state]
                    put(f"{'user' if state == USER else 'assistant'}:{text}")
        if done:
            yield _batch(done, types, names)
    if now is not None:
        inserted(state, at)
        yield _batch([(*now, sha.hexdigest())], types, names)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conv_id.

    turns: conv_id, turn, role, text, copies (how often the turn stands there in a row; 0: only
    its conversation is known). Turns are ordered by turn (null first), role and the text's
    hash. Null roles and texts count as one space; null conv_ids are one conversation; equal
    turns repeat each other. A conversation without turns has zeros, an empty audit and the hash
    of nothing. An empty table gives an empty result; other columns are ignored. Texts may be of
    any length: a task holds a slice of them, and of a conversation the audit."""
    one = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"),
        F.col("copies").cast("int").alias("copies")).withColumn("digest", F.sha2("text", 256))
    facts = rows.select(
        "conv_id", "turn", "role", "digest", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"), "copies")
    # texts that return in a later turn: the first turn of each
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = facts.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        "first < last").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = facts.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    marked = marked.withColumn("seen", F.coalesce(place > F.col("first"), F.lit(False)))
    order = ["conv_id", "turn", "role", "digest"]
    plans = marked.select(*order, "blank", "truncated", "seen", "copies").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _planned, _PLAN)
    nothing = {c: F.lit(None).cast("long").alias(c) for c in COUNTS}
    texts = rows.where("copies > 0").select(
        "conv_id", *nothing.values(), F.lit(None).cast("string").alias("audit"), "role", "text", "copies", "turn", "digest", F.lit(1).alias("kind"))
    heads = plans.select(
        "conv_id", *COUNTS, "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"),
        F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"), F.lit(0).alias("kind"))
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", *COUNTS, "audit", "role", "text", "copies").mapInArrow(_repaired, _PLAN + ", repaired_sha256 string")


def damaged(turns: DataFrame, kinds: int = 20) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as (conv_id, turn, role, text, copies), a quarter of them damaged.

    By the crc32 of ``conv_id:turn`` modulo ``kinds``: 0 drops the turn, 1 empties its text, 2
    removes the ends of sentences, 3 repeats it, 4 gives it to the user. Nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % kinds
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"),
                        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
