"""Keyword account search, radar filters, facets and quick stats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from scanmart.operators import grams as G
from scanmart.operators.scalars import attach

from scanmart.functions import columns as C
from scanmart.functions import constants as K

TOKEN_SPLIT = r"[^a-z0-9.\-]+"


# ------------------------------------------------------------------ single question (M1)
def question_terms(question: str) -> tuple[str, list[str]]:
    """Driver-side parsing of one question literal: casefolded text and its tokens."""
    q = question.strip().casefold()
    return q, [t for t in re.split(TOKEN_SPLIT, q) if t]


def haystack() -> Column:
    """``domain + " " + " ".join(countries)``, lower-cased."""
    countries = F.coalesce(F.col("countries").cast("array<string>"), F.array().cast("array<string>"))
    return F.lower(F.concat(F.coalesce(F.col("domain"), F.lit("")), F.lit(" "), F.array_join(countries, " ")))


def match_column(question: str) -> Column:
    q, tokens = question_terms(question)
    domain = F.lower(F.coalesce(F.col("domain"), F.lit("")))
    hay = haystack()
    conds = [domain.contains(F.lit(q))]
    conds += [domain.contains(F.lit(t)) for t in tokens if "." in t]
    conds += [hay.contains(F.lit(t)) for t in tokens if len(t) >= 3]
    for keywords, field in K.KEYWORD_FILTERS:
        if any(k in q for k in keywords):
            conds.append(F.coalesce(F.col(field), F.lit(0)) > 0)
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def search_accounts(accounts: DataFrame, question: str, limit: int = 80) -> DataFrame:
    """Rule match; no match at all -> every account; order by score desc, first ``limit``.

    The "any match" fallback is a 1-row aggregate joined back by broadcast (no collect).
    """
    if not question.strip():
        return accounts.orderBy(F.desc("opportunity_score"), F.asc("domain")).limit(limit)
    m = accounts.withColumn("_match", match_column(question))
    anym = m.agg(F.max(F.col("_match").cast("int")).alias("_any"))
    pool = (attach(m, anym)
             .filter(F.col("_match") | (F.coalesce(F.col("_any"), F.lit(0)) == 0))
             .drop("_match", "_any"))
    return pool.orderBy(F.desc_nulls_last(F.coalesce(F.col("opportunity_score"), F.lit(0.0))),
                        F.asc("domain")).limit(limit)


# ------------------------------------------------------------------ many questions (M2)
#: Rows that the terms are broadcast in.
TERM_BLOCKS = 16


def text_matches(accounts: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """(s, kind, domain, _score): for each term its first ``limit`` accounts (score desc, domain asc) that contain it.

    accounts: domain, _score, _dom and _hay (texts in lower case; _dom is the start of _hay);
    terms: s, kind, distinct; kind ``d`` is sought in _dom, ``h`` in _hay. Terms one of whose grams no
    account has are dropped; the others are broadcast, each with the rarest of its grams. A task finds
    its accounts' grams among those, verifies the terms that are looked up under them and hands on the
    first ``limit`` accounts of each: no text is shuffled or sorted."""
    spelled = terms.where("s <> ''").mapInArrow(G.spelled, "s string, kind string, g int, grams int")
    often = accounts.select("_hay").mapInArrow(G.counted, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    rarest = spelled.join(often.hint("merge"), "g").groupBy("s", "kind", "grams").agg(F.min(F.struct("n", "g")).alias("r"), F.count(F.lit(1)).alias("_had"))
    block = F.pmod(F.xxhash64("s", "kind"), F.lit(TERM_BLOCKS))
    blocks = rarest.where("_had = grams").groupBy(block.alias("_block")).agg(
        F.collect_list(F.struct("s", "kind", F.col("r.g").alias("g"))).alias("_terms")).select("_terms")
    # the first account of a partition brings all terms into its task; a row without terms brings every account
    no_terms = accounts.sparkSession.range(1).select(F.lit(None).cast(blocks.schema["_terms"].dataType).alias("_terms"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    texts = accounts.select("domain", "_score", F.octet_length("_dom").alias("_n"), "_hay", first.alias("_first"))
    dealt = texts.join(F.broadcast(blocks.unionByName(no_terms)), F.col("_terms").isNull() | F.col("_first"))
    found = dealt.mapInArrow(G.first_matches(limit), "s string, kind string, domain string, _score double")
    # exact: a question's first `limit` over the union of its terms' matches are among each term's first `limit`
    w = Window.partitionBy("s", "kind").orderBy(F.desc("_score"), F.asc("domain"))
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).select("s", "kind", "domain", "_score")


def top_list(df: DataFrame, limit: int, score: str, out: str = "top") -> DataFrame:
    """1-row frame holding the first ``limit`` (score desc, domain asc) as an ordered
    array of structs: a bounded scalar that can be broadcast."""
    best = df.orderBy(F.desc(score), F.asc("domain")).limit(limit)
    return best.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col(score)).alias("_neg"), F.col("domain"), F.col(score).alias("score")))).alias(out))


def search_batch(accounts: DataFrame, questions: DataFrame, limit: int = 80,
                 id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """Search for a whole table of questions without a questions x accounts product.

    * substring rules (:func:`text_matches`): each distinct term of all questions is looked
      up once, under its rarest gram, in one pass over the accounts, and verified; each
      term keeps only its top-``limit`` accounts, joined back to the questions by the term;
    * keyword rules are per (question, keyword group): each group's top-``limit``
      accounts are ranked once and joined to the questions that mention the group;
    * questions with no match take the global top-``limit`` (a bounded, broadcast list).
    Result: (question_id, search_rank, domain, opportunity_score), at most ``limit`` per
    question, ordered by score desc then domain.
    """
    acc = accounts.select("domain", "opportunity_score", "countries",
                          *[f for _, f in K.KEYWORD_FILTERS]).withColumn(
        "_score", F.coalesce(F.col("opportunity_score"), F.lit(0.0)))
    q = questions.select(F.col(id_col).alias("question_id"),
                         F.lower(F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")).alias("q"))
    toks = F.array_distinct(F.filter(F.split("q", TOKEN_SPLIT), lambda t: F.length(t) > 0))
    qterms = F.concat(
        F.when(F.length("q") > 0, F.array(F.struct(F.col("q").alias("s"), F.lit("d").alias("kind"))))
         .otherwise(F.array().cast("array<struct<s:string,kind:string>>")),
        F.transform(F.filter(toks, lambda t: t.contains(".")), lambda t: F.struct(t.alias("s"), F.lit("d").alias("kind"))),
        F.transform(F.filter(toks, lambda t: F.length(t) >= 3), lambda t: F.struct(t.alias("s"), F.lit("h").alias("kind"))))
    texts = acc.select("domain", "_score", F.lower(F.coalesce(F.col("domain"), F.lit(""))).alias("_dom"), haystack().alias("_hay"))
    # a term longer than every text, as most whole questions are, is not shuffled
    longest = texts.agg(F.max(F.length("_dom")).alias("d"), F.max(F.length("_hay")).alias("h"))
    q_terms = attach(q.select("question_id", F.explode(F.array_distinct(qterms)).alias("t")).select("question_id", "t.s", "t.kind"), longest).where(
        F.length("s") <= F.when(F.col("kind") == "d", F.col("d")).otherwise(F.col("h"))).select("question_id", "s", "kind")
    by_term = text_matches(texts, q_terms.select("s", "kind").distinct(), limit)
    # both sides are many rows a question: neither is broadcast for the small size of its files
    matched = q_terms.join(by_term.hint("merge"), ["s", "kind"]).select("question_id", "domain", "_score")

    # keyword groups: group-level top-`limit` lists (bounded: groups x limit rows)
    gids = F.filter(F.array(*[F.when(F.coalesce(F.col(f), F.lit(0)) > 0, F.lit(gi))
                              for gi, (_k, f) in enumerate(K.KEYWORD_FILTERS)]), lambda x: x.isNotNull())
    groups = acc.select("domain", "_score", F.explode(gids).alias("group_id"))
    wg = Window.partitionBy("group_id").orderBy(F.desc("_score"), F.asc("domain"))
    group_top = groups.withColumn("_r", F.row_number().over(wg)).filter(F.col("_r") <= limit).drop("_r")

    def mentions(keywords) -> Column:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.col("q").contains(F.lit(k))
        return hit
    qgids = F.filter(F.array(*[F.when(mentions(kws), F.lit(gi)) for gi, (kws, _f) in enumerate(K.KEYWORD_FILTERS)]),
                     lambda x: x.isNotNull())
    qgroups = q.select("question_id", F.explode(qgids).alias("group_id"))
    kw_matches = qgroups.join(F.broadcast(group_top), "group_id").select("question_id", "domain", "_score")

    # one shuffle by question: equal rows share a rank, and a row for the question itself comes after its
    # matches: where that is the first, there is none and the global top-`limit` (1-row scalar) takes its place
    asked = q.where(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.count(F.lit(1)).alias("_asked"))
    matches = matched.unionByName(kw_matches).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("question_id").orderBy(F.asc_nulls_first("_asked"), F.desc("_score"), F.asc("domain"))
    ranked = matches.withColumn("search_rank", F.dense_rank().over(w)).filter(F.col("search_rank") <= limit).distinct()
    top = top_list(acc, limit, "_score")
    listed = F.transform("top", lambda t, i: F.struct((i + 1).alias("search_rank"), t["domain"].alias("domain"), t["score"].alias("_score")))
    own = F.array(F.struct("search_rank", "domain", "_score"))
    out = (attach(ranked.filter(F.col("_asked").isNull() | (F.col("search_rank") == 1)), top)
           .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_asked", F.lit(1)))))
           .select("question_id", F.explode(F.when(F.col("_asked").isNull(), own).otherwise(listed)).alias("t")))
    # no match is known by a missing id
    unnamed = attach(q.where(F.col("question_id").isNull()).select("question_id"), top).select("question_id", F.explode(listed).alias("t"))
    return out.unionByName(unnamed).select("question_id", F.col("t.search_rank").cast("int").alias("search_rank"), F.col("t.domain").alias("domain"),
                                           F.col("t._score").alias("opportunity_score"))


# ------------------------------------------------------------------ radar / facets / stats
SIGNAL_CHECKS = {
    "Critical vulnerability": "critical_vulnerability_observations",
    "Exposed database": "exposed_database_count",
    "Remote access": "exposed_remote_access_count",
    "EOL product": "eol_observation_count",
}


def radar_filter(accounts: DataFrame, search: str = "", score_range=(40.0, 100.0), countries=(),
                 cloud_only: bool = False, min_vulnerabilities: int = 0, signals=(), limit: int | None = None) -> DataFrame:
    """Dashboard filter: domain substring AND score range AND any selected country AND
    cloud AND minimum vulnerabilities AND every selected signal check. With ``limit``, the
    first rows by falling score."""
    cond = F.lower(F.coalesce(F.col("domain"), F.lit(""))).contains(F.lit(search.strip().casefold()))
    score = F.coalesce(F.col("opportunity_score"), F.lit(0.0))
    cond = cond & (score >= score_range[0]) & (score <= score_range[1])
    if countries:
        cond = cond & F.coalesce(F.arrays_overlap(F.col("countries"), C.str_array(countries)), F.lit(False))
    if cloud_only:
        cond = cond & (F.coalesce(F.col("cloud_observation_count"), F.lit(0)) != 0)
    cond = cond & (F.coalesce(F.col("vulnerability_count"), F.lit(0)) >= min_vulnerabilities)
    for s in signals:
        cond = cond & (F.coalesce(F.col(SIGNAL_CHECKS[s]), F.lit(0)) > 0)
    found = accounts.filter(cond)
    return found if limit is None else found.orderBy(score.desc(), "domain").limit(limit)


def country_facet(accounts: DataFrame, top: int = 30) -> DataFrame:
    """Most common countries over accounts (ties by name)."""
    return (accounts.select(F.explode("countries").alias("country")).filter(F.col("country").isNotNull())
            .groupBy("country").agg(F.count(F.lit(1)).alias("accounts"))
            .orderBy(F.desc("accounts"), F.asc("country")).limit(top))


def quick_stats(accounts: DataFrame) -> DataFrame:
    """Matching accounts, with critical signals, cloud observed, average score."""
    return accounts.agg(
        F.count(F.lit(1)).alias("matching_accounts"),
        F.count_if(F.coalesce(F.col("critical_vulnerability_observations"), F.lit(0)) > 0).alias("critical_signals"),
        F.count_if(F.coalesce(F.col("cloud_observation_count"), F.lit(0)) != 0).alias("cloud_observed"),
        F.round(F.avg(F.coalesce(F.col("opportunity_score"), F.lit(0.0))), 1).alias("avg_opportunity_score"),
    )


def compact_rows(accounts: DataFrame) -> DataFrame:
    """Shortlist row: score rounded to 1, zero-filled counts, first country."""
    z = C.zero
    return accounts.select(
        "domain",
        F.round(F.coalesce(F.col("opportunity_score"), F.lit(0.0)), 1).alias("opportunity_score"),
        z("vulnerability_count").alias("vulnerability_count"),
        z("critical_vulnerability_observations").alias("critical"),
        z("exposed_database_count").alias("exposed_databases"),
        z("exposed_remote_access_count").alias("remote_access"),
        z("eol_observation_count").alias("eol"),
        z("cloud_observation_count").alias("cloud"),
        F.get(F.filter(F.col("countries"), lambda c: c.isNotNull() & (c != "")), 0).alias("country"),
    )


def display_columns(accounts: DataFrame, now: Column | None = None) -> DataFrame:
    """Primary country, signal summary tags, humanized last-seen and score band."""
    now = now if now is not None else F.localtimestamp()
    tags = F.array(
        F.when(C.zero("critical_vulnerability_observations") != 0, F.lit("Critical")),
        F.when(C.zero("exposed_database_count") != 0, F.lit("Exposed DB")),
        F.when(C.zero("exposed_remote_access_count") != 0, F.lit("Remote")),
        F.when(C.zero("eol_observation_count") != 0, F.lit("EOL")),
    )
    summary = F.array_join(F.filter(tags, lambda t: t.isNotNull()), " · ")
    days = F.greatest(F.lit(0), F.floor(
        (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")))
        / 86400e6).cast("int"))
    last_seen = (F.when(F.col("last_seen").isNull(), F.lit("—"))
                 .when(days == 0, F.lit("today")).when(days == 1, F.lit("1 day ago"))
                 .when(days < 90, F.concat(days.cast("string"), F.lit(" days ago")))
                 .otherwise(F.substring(F.col("last_seen").cast("string"), 1, 19)))
    score = F.coalesce(F.col("opportunity_score"), F.lit(0.0))
    return accounts.select(
        "*",
        F.coalesce(F.get(F.filter(F.col("countries"), lambda c: c.isNotNull() & (c != "")), 0), F.lit("—"))
         .alias("primary_country"),
        F.when(summary == "", F.lit("—")).otherwise(summary).alias("signal_summary"),
        last_seen.alias("last_seen_label"),
        F.when(score >= 80, F.lit("high")).when(score >= 65, F.lit("medium")).otherwise(F.lit("low"))
         .alias("score_band"),
    )


def shortlist_join(matches: DataFrame, shortlist: DataFrame, id_col: str = "list_id") -> DataFrame:
    """Apply an ordered shortlist per list: keep the given order, drop unknown domains.

    ``shortlist`` holds (list_id, domains array). Output: (list_id, position, domain,
    shows_all). A list with no known domain shows all matches instead: it is one row with
    ``shows_all``, which :func:`shown` resolves for the list on display, so the matches are
    not copied for every such list.
    """
    pos = shortlist.select(id_col, F.posexplode("domains").alias("position", "domain"))
    known = pos.join(matches.select("domain"), "domain", "left_semi")
    known = known.groupBy(id_col, "domain").agg(F.min("position").alias("position"))
    wk = Window.partitionBy(id_col).orderBy("position")
    known = known.select(id_col, (F.row_number().over(wk) - 1).cast("int").alias("position"), "domain",
                         F.lit(False).alias("shows_all"))
    empty = shortlist.select(id_col).join(known.select(id_col).distinct(), id_col, "left_anti")
    return known.unionByName(empty.select(id_col, F.lit(0).alias("position"), F.lit(None).cast("string").alias("domain"),
                                          F.lit(True).alias("shows_all")))


def shown(matches: DataFrame, joined: DataFrame, list_id, id_col: str = "list_id") -> DataFrame:
    """The accounts that one list shows, in order: its known domains, or all matches by score."""
    own = joined.filter(F.col(id_col) == F.lit(list_id))
    picked = matches.join(own.select("domain", "position"), "domain").orderBy("position")
    if own.filter("shows_all").limit(1).count():
        return matches.orderBy(F.desc(F.coalesce("opportunity_score", F.lit(0.0))), "domain")
    return picked.drop("position")
