"""Evidence packs, prompts, prompt cache keys and response payload parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmart.operators.signals import severity_rank

# fixed values: evidence constraints and the prompt's evidence sentence
CONSTRAINTS = (
    "Do not invent company identity, industry, employee count, or contacts.",
    "Treat scores as precomputed. Do not recalculate opportunity_score.",
    "Separate observed facts from hypotheses. Label uncertainty.",
)
EVIDENCE_SENTENCE = "Use only the JSON evidence below. If a fact is missing, say it is missing."


def account_signal_lists(signals: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` signals per account by severity rank then name (WindowGroupLimit
    trims before the shuffle), as an ordered array of 5-field structs."""
    w = Window.partitionBy("domain").orderBy(severity_rank(), F.asc("signal_name"))
    top = signals.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    return top.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("_r"), F.col("signal_type").alias("type"), F.col("signal_name").alias("name"), "severity",
        "description", "confidence"))), lambda s: s.dropFields("_r")).alias("signals"))


def evidence_pack(scored: DataFrame, signal_lists: DataFrame, workflow: str) -> DataFrame:
    """One evidence struct per account: scores, footprint, parsed reasons, signals, constraints."""
    j = scored.join(signal_lists, "domain", "left")
    reasons = F.coalesce(F.from_json("score_reasons", "array<string>"), F.array(F.col("score_reasons")))
    return j.select("domain", F.struct(
        F.lit(workflow).alias("workflow"),
        F.col("domain"),
        F.struct(F.col("opportunity_score").alias("opportunity"), F.col("exposure_score").alias("exposure"),
                 F.col("vulnerability_score").alias("vulnerability"),
                 F.col("technology_score").alias("technology"), F.col("recency_score").alias("recency"))
         .alias("scores"),
        F.struct(F.col("unique_ip_count").alias("unique_ips"), F.col("unique_port_count").alias("unique_ports"),
                 F.col("unique_service_count").alias("unique_services"),
                 F.col("cloud_observation_count").alias("cloud_observations"),
                 F.col("exposed_database_count").alias("exposed_databases"),
                 F.col("exposed_remote_access_count").alias("exposed_remote_access"),
                 F.col("eol_observation_count").alias("eol_observations"),
                 F.col("vulnerability_count").alias("vulnerability_count"),
                 F.col("critical_vulnerability_observations").alias("critical_vulnerabilities"),
                 F.col("high_vulnerability_observations").alias("high_vulnerabilities")).alias("footprint"),
        reasons.alias("score_reasons"),
        F.coalesce(F.col("signals"), F.array().cast(signal_lists.schema["signals"].dataType)).alias("signals"),
        F.array(*[F.lit(c) for c in CONSTRAINTS]).alias("constraints"),
    ).alias("evidence"))


def prompts(evidence: DataFrame, instructions: str, prompt_version: str, model: str, extra: str = "") -> DataFrame:
    """Prompt text = instructions + optional extra + evidence sentence + fenced JSON; the
    cache key is ``version:sha256(model + newline + prompt)``."""
    extra_block = f"{extra.strip()}\n\n" if extra.strip() else ""
    prompt = F.concat(F.lit(f"{instructions.strip()}\n\n{extra_block}{EVIDENCE_SENTENCE}\n\n```json\n"),
                      F.to_json("evidence"), F.lit("\n```"))
    key = F.concat(F.lit(f"{prompt_version}:"), F.sha2(F.concat(F.lit(f"{model}\n"), prompt), 256))
    return evidence.select("domain", prompt.alias("prompt"), key.alias("cache_key"))


def cache_lookup(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join of requests to a response table on the cache key (``cached`` flag)."""
    r = responses.select("cache_key", F.col("text").alias("cached_text"))
    return requests.join(r, "cache_key", "left").withColumn("cached", F.col("cached_text").isNotNull())


def parse_payload(responses: DataFrame, text_col: str = "text", fallback_col: str = "fallback") -> DataFrame:
    """First ``{...}`` block (greedy, across lines) -> (explanation, domains); no block or
    bad JSON -> stripped text and the fallback list; empty domain list -> fallback."""
    block = F.regexp_extract(F.col(text_col), r"(?s)(\{.*\})", 1)
    v = F.when(block != "", F.try_parse_json(block))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    stripped = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+|\s+$", "")
    doms = F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.domains", "array<variant>"),
                                           F.array().cast("array<variant>")),
                                lambda x: F.when(F.schema_of_variant(x) == "STRING",
                                                 F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))),
                    lambda x: x.isNotNull() & (x != "") & (x != "null"))
    expl = F.coalesce(F.nullif(F.try_variant_get(v, "$.explanation", "string"), F.lit("")), stripped)
    return responses.select(
        "*",
        F.when(is_obj, expl).otherwise(stripped).alias("explanation"),
        F.when(is_obj & (F.size(doms) > 0), doms).otherwise(F.col(fallback_col)).alias("domains"),
    )


def allowed_domains(parsed: DataFrame, id_col: str, candidates: DataFrame, fallback_col: str = "fallback") -> DataFrame:
    """``parsed`` (id, domains array, fallback array) with ``domains`` cut to the id's candidates.

    The order and repeats of the list stay; an answer without any candidate shows the
    fallback. ``candidates``: (id, domain) rows."""
    pos = parsed.select(id_col, F.posexplode("domains").alias("_p", "domain"))
    kept = pos.join(candidates.select(id_col, "domain").distinct(), [id_col, "domain"], "left_semi")
    lists = kept.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_p", "domain"))), lambda s: s["domain"]).alias("_kept"))
    return parsed.join(lists, id_col, "left").withColumn("domains", F.coalesce("_kept", F.col(fallback_col))).drop("_kept")


# fixed values: constraints of the explore evidence
EXPLORE_CONSTRAINTS = ("Only use domains from shortlist", "Do not invent firmographics")


def explore_pack(rows: DataFrame, question: str) -> DataFrame:
    """One evidence struct of a question: the question, its ranked compact rows and the constraints.

    ``rows``: at most the 25 rows of the shortlist, with ``rank``."""
    cols = [c for c in rows.columns if c != "rank"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", *cols))), lambda s: s.dropFields("rank"))
    return rows.agg(listed.alias("shortlist")).select(F.struct(
        F.lit(question).alias("question"), "shortlist",
        F.array(*[F.lit(c) for c in EXPLORE_CONSTRAINTS]).alias("constraints")).alias("evidence"))
