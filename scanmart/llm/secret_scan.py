"""Secret scans by assignment-aware lexing.

Three base patterns (keyword assignments, access key ids, hexadecimal runs) and a lexer of
source and configuration syntax: name-literal pairs are parsed from assignments in the
usual notations (also typed declarations, quoted subscripts, ``#define``, XML elements,
name and value attributes, YAML tags and block values), constants are propagated through names,
concatenations and call arguments, and a literal
is scored by how sensitive the names are that it reaches and by how random it looks.

Documents are scanned whole, in one narrow pass without a shuffle. The time of a text is in
proportion to its length: no place is lexed again for each assignment before it, names refer
to earlier assignments instead of holding their literals, and literals that end at the same
place are weighed together.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 or more: shorter maximal runs fail anyway
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

#: Parts of a name and their weight; a name's sensitivity is the largest of its parts'.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 1.0, "privatekey": 1.0, "signingkey": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8,
}
#: What a document must hold, in lower case, for the lexer to find anything.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer")
_BLANK = r"changed?|replace|insert|enter|example|placeholder|your|dummy|sample|redacted|todo|none|null|true|false"
_FILLER = r"password|passwd|passphrase|pwd|secret|token|credentials?|value|access|private|signing|client|auth|api|key|here|goes|with|this|the|me|my|it"
#: Whole values that stand for a secret: a reference, a name in angle brackets, a mask, or placeholder words with
#: separators. A value that only contains such a sign or word is none.
PLACEHOLDER = re.compile(
    r"\$\{(?:env:)?[A-Za-z_][\w.]*\}|\$(?:[A-Z]+(?:_[A-Z]+)*|[a-z]+(?:_[a-z]+)+)|<[A-Za-z][\w .:/-]*>|[xX*.]+"
    rf"|(?i:(?:(?:{_FILLER})[-_. ]*)*+(?:{_BLANK})[-_. ]*(?:(?:{_BLANK}|{_FILLER})[-_. ]*)*+)")
THRESHOLD = 0.5
LITERAL_CHARS = 8

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
_SUBSCRIPT = r"""\[[ \t]*(?:"[^"\n\]]{1,200}"|'[^'\n\]]{1,200}'|:?\w*)[ \t]*\]"""
# A type: dotted words with no digits but a width, arguments two deep, arrays, optional marks and unions.
_GENERIC = r"(?:<[^<>\n]{0,200}(?:<[^<>\n]{0,200}>[^<>\n]{0,200}){0,9}>|\[[^\[\]\n]{0,200}(?:\[[^\[\]\n]{0,200}\][^\[\]\n]{0,200}){0,9}\])"
_ATOM = rf"[&*]*(?:'[a-z_]+[ ])?(?:(?:mut|dyn|const|readonly)[ ])?[A-Za-z_]+(?:(?:\.|::)[A-Za-z_]+)*(?:8|16|32|64|128)?{_GENERIC}{{0,3}}[?!]?"
_TYPE = rf"""(?:(?P<tq>["']){_ATOM}(?P=tq)|{_ATOM}(?:[ \t]*\|[ \t]*{_ATOM})*)"""
_ONE_TYPE = re.compile(_ATOM)
#: A target and its sign: a name, quoted or not, the key of a subscript, an array, and a type before the sign.
_START = re.compile(
    rf"""(?<![A-Za-z0-9_.$-])(?P<symbol>(?<=\[):)?(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?(symbol)\]|(?:(?<=["'])[ \t]*\]|(?:\[\w*\])*))"""
    rf"""(?:[?!]?[ \t]*:[ \t]*(?P<type>{_TYPE})[ \t]*(?==(?![=>]))|[ \t]+(?P<plain>\*?string|\[\]byte|[Aa]s[ \t]+[A-Za-z.]+)[ \t]*(?=:?=(?!=)))?"""
    r"""[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*""")
#: What a subscript's key belongs to: the names and keys before its bracket.
_OWNER = re.compile(rf"""{_NAME}(?:{_SUBSCRIPT})*[ \t]*\[[ \t]*["':]\Z""")
#: How far before a key its owner is looked for.
OWNER_CHARS = 400
#: Literals: three quotes, one quote, backquotes; with the prefixes of several languages.
_STRING = re.compile(
    r"""(?:[rRbBfFuU]{1,2}|u8|[L$@]|\$@|@\$)?(?:"{3}(?P<t>(?:[^"\\]++|\\.|"(?!""))*+)"{3}|'{3}(?P<u>(?:[^'\\]++|\\.|'(?!''))*+)'{3}"""
    r"""|"(?P<d>(?:[^"\\\n]++|\\.)*+)"|'(?P<s>(?:[^'\\\n]++|\\.)*+)'|`(?P<b>[^`\n]*+)`)""", re.DOTALL)
_VARIABLE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?")
#: Where a bare word ends.
_STOP = re.compile(rf"""[\s"'`,;(){{}}\[\]+]|&(?={_NAME}=)""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|\|\|)[ \t]*|[ \t]*\\\n[ \t]*")
_BESIDE = re.compile(r"""[ \t]*(?=(?:[rRbBfFuU]{1,2}|L)?["'])""")
_BETWEEN = re.compile(r"[\s,+]+")
#: A tag before a value, the head of a block value, and the next line of one.
_YAML = re.compile(r"!{1,2}[A-Za-z][\w./:-]{0,100}[ \t]+|[|>][+-]?\d?[ \t]*\n[ \t]+")
_LINE = re.compile(r"[ \t]*\n[ \t]+(?=[^\s:#-][^\s:]*[ \t]*(?:\n|\Z))")
_DEFINE = re.compile(rf"#[ \t]*define[ \t]+(?P<name>{_NAME})[ \t]+")
_ELEMENT = re.compile(rf"<(?:[A-Za-z][\w-]{{0,40}}:)?(?P<name>{_NAME})(?:[ \t][^<>\n]{{0,200}})?>(?P<value>[^<>\n]+)(?=</)")
#: The name of a pair that names its value apart: ``name="password" value="..."``, ``- name: TOKEN`` and ``value: ...``.
_APART = re.compile(
    rf"""(?<![\w.-])["']?(?:name|key|id|field)["']?[ \t]*[:=][ \t]*(?P<q>["']?)(?P<name>{_NAME})(?P=q)[ \t]*[,;]?\s{{0,80}}"""
    rf"""["']?(?:value|content|default)["']?[ \t]*[:=][ \t]*""")
#: Spans with one end that are more than this are weighed in one go.
SHARED_END = 8


@functools.lru_cache(maxsize=1 << 14)
def _word_weight(name: str) -> float:
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    return max((SENSITIVE.get(x, 0.0) for x in [*parts, *map("".join, zip(parts, parts[1:]))]), default=0.0)


def name_weight(name: str) -> float:
    """How sensitive a target name is: its snake, kebab and camel case parts, alone and in pairs."""
    return _word_weight(name) if len(name) <= 256 else _word_weight.__wrapped__(name)


def _weight(length: int, entropy: float, kinds: int, digits: bool) -> float:
    if kinds == 1 and not digits:
        return 0.0  # a plain word
    return min(1.0, entropy / 3.0) * min(1.0, 0.4 + 0.2 * kinds)


_KINDS = (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]")


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: length, mixed characters and entropy; 0 for words and placeholders."""
    if len(value) < LITERAL_CHARS or re.search(r"\s", value) or PLACEHOLDER.fullmatch(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    return _weight(len(value), entropy, sum(bool(re.search(p, value)) for p in _KINDS), value.isdigit())


def literal_weights(text: str, spans: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """``literal_weight`` of each span; many that end at one place are gone through once, from the last start back."""
    ends: dict[int, list[int]] = {}
    for i, j in spans:
        ends.setdefault(j, []).append(i)
    out = {}
    for j, starts in ends.items():
        if len(starts) <= SHARED_END:
            out.update({(i, j): literal_weight(text[i:j]) for i in starts})
            continue
        counts: Counter = Counter()
        kinds, digits, white, total, at = set(), True, False, 0.0, j
        for i in sorted(starts, reverse=True):
            for c in text[i:at]:
                if (n := counts[c]):
                    total += (n + 1) * math.log2(n + 1) - n * math.log2(n)
                else:
                    kinds |= {k for k, p in enumerate(_KINDS) if re.match(p, c)}
                    digits, white = digits and c.isdigit(), white or c.isspace()
                counts[c] = n + 1
            at, n = i, j - i
            plain = n < LITERAL_CHARS or white or PLACEHOLDER.fullmatch(text, i, j)
            out[i, j] = 0.0 if plain else _weight(n, math.log2(n) - total / n, len(kinds), digits)
    return out


class Lexer:
    """The assignments of a text: (target, spans of its own literals, earlier assignments that it refers to)."""

    def __init__(self, text: str):
        self.text, self.found, self.known, self.lengths = text, [], {}, set()
        self.run = self.stripped = (0, 0)
        self.angle = -1

    def _word(self, at: int) -> int:
        """The end of the bare word at ``at``; the ends of a run of them are looked for once."""
        if not self.run[0] <= at < self.run[1]:
            stop = _STOP.search(self.text, at)
            end = stop.start() if stop else len(self.text)
            dots, marks = end, end
            while dots > at and self.text[dots - 1] == ".":
                dots -= 1
            while marks > at and self.text[marks - 1] in ".:":
                marks -= 1
            self.run, self.stripped = (at, end), (dots, marks)
        return self.run[1]

    def _known(self, start: int, end: int) -> int | None:
        return self.known.get(self.text[start:end]) if end - start in self.lengths else None

    def _has_angle(self, start: int, end: int) -> bool:
        if self.angle < start:
            self.angle = self.text.find("<", start)
            self.angle = len(self.text) if self.angle < 0 else self.angle
        return self.angle < end

    def _bare(self, at: int, spans: list, refs: list) -> int:
        end = self._word(at)
        dots, marks = max(self.stripped[0], at), max(self.stripped[1], at)
        if (ref := self._known(at, dots)) is not None:
            refs.append(ref)
        elif not (self._has_angle(at, end) and (t := _ONE_TYPE.match(self.text, at)) and t.end() >= end):
            spans.append((at, marks))
        return end

    def _string(self, at: int, spans: list) -> int | None:
        if not (m := _STRING.match(self.text, at)):
            return None
        spans.append(m.span(m.lastgroup))
        return m.end()

    def _bracket(self, at: int, spans: list, refs: list) -> tuple[int, bool]:
        """The literals in the brackets that open at ``at``, and names; up to their end or the next assignment in them.

        (where it ends, whether the brackets are closed)"""
        text, depth = self.text, 0
        while at < len(text):
            if (end := self._string(at, spans)) is not None:
                at = end
            elif text[at] in "([":
                depth, at = depth + 1, at + 1
            elif text[at] in ")]":
                depth, at = depth - 1, at + 1
                if not depth:
                    return at, True
            elif m := _BETWEEN.match(text, at):
                at = m.end()
            elif text[at] in "{};`\"'&":
                return at, False
            else:
                end = self._word(at)
                if text.find("=", at, end) >= 0 or text[end - 1] == ":":
                    return at, False  # an argument with a name
                if (ref := self._known(at, max(self.stripped[0], at))) is not None:
                    refs.append(ref)
                at = end
        return at, False

    def _value(self, at: int) -> tuple[list, list, int, bool]:
        """(spans, references, end, whether starts are to be looked for inside) of the value at ``at``."""
        text, spans, refs, terms, inside = self.text, [], [], 0, False
        block = False
        while m := _YAML.match(text, at):
            at, block = m.end(), block or "\n" in m[0]
        while at < len(text):
            terms += 1
            strings = True
            if (end := self._string(at, spans)) is not None:
                at = end
            elif text[at] in "([":
                at, closed = self._bracket(at, spans, refs)
                inside = True
                if not closed:
                    break
            elif m := _VARIABLE.match(text, at):
                at, strings = m.end(), False
                if (ref := self._known(*m.span(1))) is not None:
                    refs.append(ref)
            elif not _STOP.match(text, at):
                end, strings = self._word(at), False
                inside = True
                if text[end:end + 1] == "(":  # a call: its arguments, not its name
                    at, closed = self._bracket(end, spans, refs)
                    if not closed:
                        break
                else:
                    at = self._bare(at, spans, refs)
            else:
                break
            joint = _PLUS.match(text, at) or strings and _BESIDE.match(text, at) or block and _LINE.match(text, at)
            if not joint:
                break
            at = joint.end()
        return spans, refs, at, inside and terms == 1

    def _target(self, start: re.Match) -> str:
        """The name of an assignment's target, with the owner's if it is a subscript's key."""
        text, at = self.text, start.start("name")
        if text[at - 1:at] not in ("'", '"', ":") or not at or text[max(0, at - OWNER_CHARS):at - 1].rstrip(" \t")[-1:] != "[":
            return start["name"]
        owner = _OWNER.search(text[max(0, at - OWNER_CHARS):at])
        return owner[0] + start["name"] if owner else start["name"]

    def _add(self, target: str, spans: list, refs: list, name: str | None) -> None:
        if spans or refs:
            if name is not None:
                self.known[name] = len(self.found)
                self.lengths.add(len(name))
            self.found.append((target, list(dict.fromkeys(spans)), list(dict.fromkeys(refs))))

    def assignments(self) -> list[tuple[str, list[tuple[int, int]], list[int]]]:
        text, at = self.text, 0
        others = sorted((m.start(), k, m) for k, p in enumerate((_DEFINE, _ELEMENT, _APART)) for m in p.finditer(text))
        others = iter([*others, (len(text) + 1, 0, None)])
        next_at, kind, other = next(others)
        while True:
            start = _START.search(text, at)
            upto = start.start() if start else len(text)
            while next_at <= upto:
                if kind == 1:
                    self._add(other["name"], [self._trimmed(*other.span("value"))], [], None)
                else:
                    spans, refs, _, _ = self._value(other.end())
                    self._add(other["name"], spans, refs, other["name"] if kind == 0 else None)
                next_at, kind, other = next(others)
            if not start:
                return self.found
            spans, refs, at, inside = self._value(start.end())
            plain = start["q"] == "" or len(spans) + len(refs) > 1 or name_weight(start["name"])
            self._add(self._target(start), spans, refs, start["name"] if plain else None)
            # a bare word or an argument may itself be the next assignment: `a = b = "x"`, `url: password=...`, `f(password="x")`
            at = start.end() if inside else max(at, start.end())
            # a type may itself be a name: `url: password = "x"`
            if start["type"] or start["plain"]:
                at = start.start("type" if start["type"] else "plain")

    def _trimmed(self, i: int, j: int) -> tuple[int, int]:
        value = self.text[i:j]
        return i + len(value) - len(value.lstrip()), j - (len(value) - len(value.rstrip()))


def name_literals(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(name, spans of the literals that its value is made of), in order of the text.

    A value is a chain of terms joined by a concatenation sign, or literals side by side; a term
    is a literal, a bare word, literals in brackets or in a call, or a reference to an earlier
    name, which stands for that name's literals. A target may be an array, have a type before
    the sign or be a quoted subscript, whose name is that of the owner and the key."""
    found, out = Lexer(text).assignments(), []
    for name, spans, refs in found:
        out.append((name, list(dict.fromkeys([*(s for r in refs for s in out[r][1]), *spans]))))
    return out


def sensitive_literals(text: str) -> set[tuple[int, int]]:
    """The literals that reach a sensitive name and look like secrets.

    An assignment's sensitivity goes to the earlier assignments that it refers to, the last first."""
    found = Lexer(text).assignments()
    weights = [name_weight(name) for name, _, _ in found]
    reached: dict[tuple[int, int], float] = {}
    for k in range(len(found) - 1, -1, -1):
        if weights[k]:
            for r in found[k][2]:
                weights[r] = max(weights[r], weights[k])
            for span in found[k][1]:
                reached[span] = max(reached.get(span, 0.0), weights[k])
    looks = literal_weights(text, set(reached))
    return {s for s, w in reached.items() if w * looks[s] >= THRESHOLD}


def secrets(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end), sorted: places in code points, ends exclusive."""
    if not text:
        return []
    found = [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        found += [(i, 3, j, i, j) for i, j in sensitive_literals(text)]
    return sorted(found)


def _listed(found) -> str:
    return ",".join(f"{KINDS[kind]}:{i}:{j}" for i, kind, j, _, _ in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans) for every row.

    Null and empty texts have no spans (the hash of an empty list); texts of any length are
    scanned whole, in time and memory in proportion to their length; repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for part in sliced(batches):
            rows = [secrets(t) for t in part.column("text").to_pylist()]
            counts = [Counter(x[1] for x in r) for r in rows]
            base = [hashlib.sha256(_listed(x for x in r if x[1] < 3).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(base),
                 pa.array([_listed(r) for r in rows])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each secret value (overlapping ones as one) replaced by a mark; names stay."""
    out, at, open_to = [], 0, -1
    for i, j in sorted((x[3], x[4]) for x in secrets(text)):
        if i > open_to:
            out += [text[at:i], mark]
            at = open_to = j
        elif j > open_to:
            at = open_to = j
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced and ``n_chars``, where it is there, following the new text.

    Every row stays, with all its columns; null and empty texts and texts without secrets are
    as they were; long texts are as in ``scan``."""
    names = docs.columns

    def run(batches):
        for part in sliced(batches):
            old = part.column("text").to_pylist()
            new = [redacted(t) for t in old]
            if "n_chars" in names:
                chars = part.column("n_chars").to_pylist()
                chars = [c if a == b else len(b) for a, b, c in zip(old, new, chars)]
                at = names.index("n_chars")
                part = part.set_column(at, part.schema.field(at), pa.array(chars, part.schema.field(at).type))
            at = names.index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
