"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; its failure is one bit of ``fail_mask`` and its
measurements are stored beside it. A policy is a named, versioned set of bits: applying one
to a ledger is a bitwise AND, and ablations are bitwise aggregates over the distinct masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule name -> failure condition over the measurements; a rule's bit is its place here.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 7 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "no_letters": "5 * n_letter_words < 3 * n_words",
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "no_letters"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letter_words", "n_repeat_words")


def bits(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def words_of(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), "")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable, not an inlined expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside a window of eight that is found twice or more in the same text.

    Windows are compared by a 64-bit hash of their words' hashes. Texts without a repeated
    window (most) stop at a hash-set size test; the others sort (hash, place).
    """
    n = F.size(words)

    def window_hashes(hashes: Column) -> Column:
        at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))

    def covered(found: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            beside = [F.coalesce(F.get(found, k)["h"] == x["h"], F.lit(False)) for k in (j - 1, j + 1)]
            return beside[0] | beside[1]

        places = F.array_sort(F.transform(F.filter(found, same), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"), p.alias("last")),
            lambda a: a["total"],
        )

    def counted(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            _bound(pairs, covered))

    return _bound(_bound(F.transform(words, lambda w: F.xxhash64(w)), window_hashes), counted)


def _measured(text: Column) -> Column:
    """All measurements of a text as one struct; the words are split once."""
    body = F.coalesce(text, F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{WORD_SPACE}]"))

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.translate(body, spaces, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    return _bound(words_of(text), of_words)


def ledger(docs: DataFrame, text_col: str = "text", measures: str = "measures", fail_mask: str = "fail_mask") -> DataFrame:
    """``docs`` with the struct ``measures`` and ``fail_mask`` (long, one bit per rule).

    Null and empty texts have no words: all measures zero, rule few_words fails. Texts of any
    length are measured whole, in arrays of their words and window hashes. Columns of ``docs``
    with these two names are replaced; repeated rows stay; an empty table stays empty.
    """
    rows = docs.withColumn(measures, _measured(F.col(text_col).cast("string")))
    mask = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        named = " ".join(f"{measures}.{x}" if x in MEASURES else x for x in condition.split())
        mask = mask + F.when(F.expr(named), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return rows.withColumn(fail_mask, mask)


def passes(policy: str, mask: str = "fail_mask") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(mask).bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, failed_alone, kept, kept_without): what each rule of a policy decides.

    Bitwise aggregation over the distinct masks (at most 2^rules groups, combined map-side).
    """
    used = F.lit(bits(POLICIES[policy])).cast("long")
    masks = rows.groupBy(F.col("fail_mask").bitwiseAND(used).alias("mask")).count()
    rules = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
        for i, name in enumerate(RULES) if name in POLICIES[policy]
    ]))
    each = masks.withColumn("r", rules).select("mask", "count", "r.rule", "r.bit")
    total = lambda condition, name: F.sum(F.when(F.expr(condition), F.col("count")).otherwise(0)).alias(name)
    return each.groupBy("rule").agg(
        total("mask & bit <> 0", "failed"),
        total("mask = bit", "failed_alone"),
        total("mask = 0", "kept"),
        total("mask & ~bit = 0", "kept_without"),
    )


def kept_documents(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of ``docs`` that pass a policy, with the columns of ``docs``."""
    rows = ledger(docs, measures="__measures", fail_mask="__fail_mask")
    return rows.where(passes(policy, "__fail_mask")).select(*docs.columns)
