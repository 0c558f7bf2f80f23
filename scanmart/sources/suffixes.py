"""Public-suffix rules and the registrable-domain (eTLD+1) column function.

The rule list is the public suffix list kept beside this module as package data
(``data/public_suffix_list.dat``, Mozilla Public License 2.0, unchanged), so it is there
wherever the package is. Of it the ICANN section counts: private suffixes are ignored.
The list is a fixed, bounded parameter table (~7.4k rules,
~250 KB): its keys become literal hash sets inside the expression (shipped with the
task like any broadcast constant), so resolving the suffix of a host is a few O(1)
set probes per label with no shuffle and no skew, however hot a host is.
"""

from __future__ import annotations

import functools
import os
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extra rules so the synthetic ``*.example.*`` hosts form many accounts
FIXTURE_RULES = ("example.com", "example.org", "example.net")


def _list_text() -> str:
    """The suffix list: the file named in ``SCANMART_SUFFIX_LIST``, else the package's own.

    Without a list every registrable domain would be null, so a missing one is an error."""
    if named := os.environ.get("SCANMART_SUFFIX_LIST"):
        with open(named, encoding="utf-8") as f:
            return f.read()
    return resources.files(__package__).joinpath("data/public_suffix_list.dat").read_text(encoding="utf-8")


def parse_rules(text: str, icann_only: bool = True) -> list[tuple[str, str]]:
    """(key, kind) pairs: kind ``e`` exact, ``w`` wildcard (key = rule without ``*.``),
    ``x`` exception (key = rule without ``!``)."""
    out: list[tuple[str, str]] = []
    section = None
    for raw in text.splitlines():
        line = raw.strip()
        if "===BEGIN ICANN DOMAINS===" in line:
            section = "icann"
        elif "===BEGIN PRIVATE DOMAINS===" in line:
            section = "private"
        if not line or line.startswith("//"):
            continue
        if icann_only and section != "icann":
            continue
        rule = line.split()[0].lower()
        kind = "x" if rule.startswith("!") else "w" if rule.startswith("*.") else "e"
        key = rule.removeprefix("!").removeprefix("*.")
        out.append((key, kind))
        if not key.isascii():  # hosts are met in either form
            out.append((punycode(key), kind))
    return out


def punycode(name: str) -> str:
    """A name with each non-ASCII label in its ``xn--`` form."""
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))


@functools.lru_cache(maxsize=1)
def _default_rules() -> tuple[tuple[str, str], ...]:
    return tuple(parse_rules(_list_text()))


def rule_sets(rules=None, extra=()) -> dict[str, list[str]]:
    """Rule keys by kind (``e``/``w``/``x``): the bundled list (or ``rules``) plus
    ``extra`` exact rules (e.g. :data:`FIXTURE_RULES` for the table-derived records)."""
    rules = list(rules if rules is not None else _default_rules()) + [(r.lower(), "e") for r in extra]
    out: dict[str, set[str]] = {"e": set(), "w": set(), "x": set()}
    for key, kind in rules:
        out[kind].add(key)
    return {k: sorted(v) for k, v in out.items()}


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _member_sql(expr: str, keys: list[str]) -> str:
    if not keys:
        return "false"
    return f"coalesce({expr} IN ({','.join(_sql_text(k) for k in keys)}), false)"


@functools.lru_cache(maxsize=8)
def _registrable_sql(hosts: str, extra: tuple[str, ...]) -> str:
    return _registrable_sql_for(hosts, rule_sets(extra=extra))


def _registrable_sql_for(hosts: str, sets: dict[str, list[str]]) -> str:
    """SQL text of the element-wise eTLD+1 over the array column ``hosts``.

    One SQL string (parsed once on the JVM) instead of thousands of literal Column
    objects built through the Python bridge; Catalyst turns each ``IN`` list into a
    hashed ``InSet``. Steps: labels once per host; every label tail ``t`` (and the
    next one ``t1``) once per position; the first position where an exception or exact
    rule matches ``t`` or a wildcard rule matches ``t1``; the cut.
    """
    tails = ("transform(sequence(1, greatest(size(_psl_s.labels), 1)), _psl_i -> named_struct("
             "'i', _psl_i, 'n', size(_psl_s.labels), "
             "'t', array_join(slice(_psl_s.labels, _psl_i, size(_psl_s.labels) - _psl_i + 1), '.'), "
             "'t1', CASE WHEN _psl_i < size(_psl_s.labels) THEN "
             "array_join(slice(_psl_s.labels, _psl_i + 1, size(_psl_s.labels) - _psl_i), '.') END))")
    is_x = _member_sql("_psl_p.t", sets["x"])
    hit = (f"transform({tails}, _psl_p -> named_struct('i', _psl_p.i, 'x', {is_x}, 'm', "
           f"{is_x} OR {_member_sql('_psl_p.t', sets['e'])} OR {_member_sql('_psl_p.t1', sets['w'])}))")
    first = f"get(filter({hit}, _psl_c -> _psl_c.m), 0)"
    step1 = f"transform({hosts}, _psl_h -> named_struct('h', _psl_h, 'labels', split(_psl_h, '\\\\.')))"
    step2 = f"transform({step1}, _psl_s -> named_struct('h', _psl_s.h, 'labels', _psl_s.labels, 'f', {first}))"
    start = "(CASE WHEN _psl_r.f.x THEN _psl_r.f.i + 1 ELSE _psl_r.f.i END)"
    bad = ("(_psl_r.h IS NULL OR _psl_r.h = '' OR _psl_r.h RLIKE '^\\\\d+(\\\\.\\\\d+){3}$' "
           "OR _psl_r.f IS NULL)")
    return (f"transform({step2}, _psl_r -> CASE WHEN NOT {bad} AND {start} >= 2 THEN "
            f"array_join(slice(_psl_r.labels, {start} - 1, size(_psl_r.labels) - {start} + 2), '.') END)")


def registrable_domains_of(hosts: str, sets: dict[str, list[str]] | None = None, extra=()) -> Column:
    """eTLD+1 of every (already normalized) host of the array column named ``hosts``,
    element-wise; null for IPv4, unknown TLD or a bare suffix.

    The rule keys are literal sets (a hashed ``InSet`` each), so every label tail costs
    O(1) and a hot host is no hotter than any other row: no join, no shuffle. The
    leftmost (longest) matching position wins; at that position an exception rule
    moves the suffix one label to the right.
    """
    if sets is None:
        return F.expr(_registrable_sql(hosts, tuple(extra)))
    return F.expr(_registrable_sql_for(hosts, sets))


def registrable_domain(host: str, sets: dict[str, list[str]] | None = None, extra=()) -> Column:
    """Scalar form of :func:`registrable_domains_of` over the string column ``host``."""
    return F.get(registrable_domains_of(f"array({host})", sets, extra), 0)
