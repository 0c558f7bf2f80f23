"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from scanmart.operators.scalars import attach

from scanmart.operators import marts as M
from scanmart.operators import observations as O
from scanmart.operators import scoring as SC
from scanmart.operators import signals as S
from scanmart.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


_FRAMES: dict[tuple, DataFrame] = {}


def _shared(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """One lazy DataFrame object per (session, tables, stage): queries that combine
    several marts share the same sub-plans, so Spark reuses their exchanges instead of
    re-reading and re-shuffling the tables."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _FRAMES:
        _FRAMES[key] = build()
    return _FRAMES[key]


def observations(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d, "observations", lambda: O.adapter_observations(
        table(spark, d, "events"), table(spark, d, "pages"), table(spark, d, "nation")))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d, "accounts", lambda: M.accounts_mart(observations(spark, d)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d, "scored", lambda: SC.scored_accounts(accounts(spark, d)))


def signals(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d, "signals", lambda: S.account_signals(accounts(spark, d)))


def observations_with_orgs(spark: SparkSession, d: str) -> DataFrame:
    return O.with_orgs(observations(spark, d), table(spark, d, "customer"))


QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@register("observations")
def q_observations(spark, d):
    return observations(spark, d).drop("user_id", "k")


@register("accounts_mart")
def q_accounts_mart(spark, d):
    return accounts(spark, d)


@register("services_mart")
def q_services_mart(spark, d):
    return M.services_mart(observations(spark, d))


@register("org_mart")
def q_org_mart(spark, d):
    """Organisations by falling observation count."""
    return M.org_mart(observations_with_orgs(spark, d)).orderBy(F.desc("observation_count"), "canonical_org")


@register("org_ips")
def q_org_ips(spark, d):
    return M.org_ips(observations_with_orgs(spark, d))


@register("account_signals")
def q_account_signals(spark, d):
    return signals(spark, d)


@register("scored_accounts")
def q_scored_accounts(spark, d):
    return scored(spark, d)


def many_accounts(spark, d):
    """Accounts of a finer key (domain, IP and a twentieth of the events): about as many as observations."""
    def build():
        o = observations(spark, d)
        key = lambda x: F.concat_ws("-", x, "ip_str", (F.col("event_id") % 20).cast("string"))
        return M.accounts_mart(o.withColumn("registrable_domains", F.transform("registrable_domains", key)))
    return _shared(spark, d, "many_accounts", build)


@register("accounts_mart_many")
def q_accounts_mart_many(spark, d):
    return many_accounts(spark, d)


@register("top_accounts_many")
def q_top_accounts_many(spark, d):
    """The first 1,000 of many accounts by score: the limit cuts."""
    best = CX.top_accounts(SC.scored_accounts(many_accounts(spark, d)), TOP_N)
    return best.select("domain", "opportunity_score")


@register("qualified_accounts")
def q_qualified(spark, d):
    return SC.qualified(scored(spark, d)).select("domain", "opportunity_score")


@register("score_distribution")
def q_score_distribution(spark, d):
    return SC.score_distribution(scored(spark, d))


# ------------------------------------------------------------------ ranking, evidence, context
from scanmart.operators import context as CX  # noqa: E402
from scanmart.operators import search as SE  # noqa: E402

TOP_N = 1000
EVIDENCE_PER_ACCOUNT = 5


def top(spark, d, limit: int = TOP_N):
    return _shared(spark, d, f"top{limit}", lambda: CX.top_accounts(scored(spark, d), limit))


def evidence(spark, d):
    return CX.account_evidence(observations(spark, d), top(spark, d), EVIDENCE_PER_ACCOUNT)


@register("top_accounts")
def q_top_accounts(spark, d):
    return top(spark, d)


@register("ranked_signals")
def q_ranked_signals(spark, d):
    return S.ranked_signals(signals(spark, d))


@register("account_evidence")
def q_account_evidence(spark, d):
    return evidence(spark, d)


def context(spark, d):
    """The contexts from the written observations and marts, as the batch job builds them: one scan of the observations,
    for the evidence."""
    selected = CX.top_accounts(written(spark, d, "scored", scored), TOP_N)
    found = CX.account_evidence(written(spark, d, "observations", observations), selected, EVIDENCE_PER_ACCOUNT)
    return CX.account_context(selected, written(spark, d, "signals", signals), found)


@register("account_context")
def q_account_context(spark, d):
    return CX.context_flat(context(spark, d))


# ------------------------------------------------------------------ dashboard filters and search
RADAR = dict(search="example", score_range=(40.0, 100.0), countries=("NATION_1", "NATION_2"), cloud_only=True,
             min_vulnerabilities=0, signals=("EOL product",))
QUESTIONS = {
    "search_keyword": "exposed mysql database",
    "search_domain": "example.com",
    "search_fallback": "zzqx qqzv",
}


@register("radar_filter")
def q_radar_filter(spark, d):
    return SE.radar_filter(scored(spark, d), **RADAR).select("domain", "opportunity_score")


RADAR_ROWS = 25


@register("radar_rows")
def q_radar_rows(spark, d):
    """The first rows of the radar list."""
    return SE.radar_filter(scored(spark, d), search="example", limit=RADAR_ROWS).select("domain", "opportunity_score")


INDUSTRIES, TARGET_INDUSTRIES = ("BUILDING", "MACHINERY", None), ("BUILDING",)


@register("icp_industry")
def q_icp_industry(spark, d):
    """ICP score where an industry is known and some are targets; the industry goes by the domain's length."""
    industry = F.get(F.array(*map(F.lit, INDUSTRIES)), F.length("domain") % len(INDUSTRIES))
    return scored(spark, d).select("domain", R.C.industry_override(F.col("icp_score"), industry, TARGET_INDUSTRIES).alias("icp_score"))


@register("country_facet")
def q_country_facet(spark, d):
    # countries come from the accounts mart (one row per account, as the scored table)
    return SE.country_facet(accounts(spark, d), 30)


@register("quick_stats")
def q_quick_stats(spark, d):
    return SE.quick_stats(scored(spark, d))


def _search(name):
    def q(spark, d):
        return SE.search_accounts(scored(spark, d), QUESTIONS[name], 80).select("domain", "opportunity_score")
    return q


for _name in QUESTIONS:
    register(_name)(_search(_name))


def user_questions(spark, d):
    """User turns of the conversations table as search questions (whole texts)."""
    conv = table(spark, d, "conversations")
    return conv.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


@register("search_batch")
def q_search_batch(spark, d):
    """All user turns as questions to the written scored accounts."""
    return SE.search_batch(written(spark, d, "scored", scored), user_questions(spark, d), 80)


@register("search_batch_many")
def q_search_batch_many(spark, d):
    """The same questions to many accounts."""
    many = written(spark, d, "scored_many", lambda s, x: SC.scored_accounts(many_accounts(s, x), M.sightings(observations(s, x))))
    return SE.search_batch(many, user_questions(spark, d), 80)


@register("explore_evidence")
def q_explore_evidence(spark, d):
    found = SE.search_accounts(scored(spark, d), QUESTIONS["search_keyword"], 80).limit(25)
    return SE.compact_rows(found)


@register("explore_pack")
def q_explore_pack(spark, d):
    """The evidence of one question: its text, the ranked shortlist and the constraints."""
    found = SE.search_accounts(scored(spark, d), QUESTIONS["search_keyword"], 80)
    ranked = CX.ranked_accounts(found).limit(25)
    w = Window.orderBy(F.desc(F.coalesce("opportunity_score", F.lit(0.0))), "domain")
    ranks = ranked.select("domain", F.row_number().over(w).alias("rank"))  # 25 rows
    rows = SE.compact_rows(ranked).join(ranks, "domain")
    pack = EV.explore_pack(rows, QUESTIONS["search_keyword"])
    return pack.select("evidence.question", F.transform("evidence.shortlist", lambda r: r["domain"]).alias("domains"),
                       F.transform("evidence.shortlist", lambda r: r["critical"]).alias("critical"), "evidence.constraints")


@register("display_columns")
def q_display_columns(spark, d):
    sc = scored(spark, d)
    ref = SC.reference_time(sc)
    out = SE.display_columns(attach(sc, ref), now=F.col("reference_time"))
    return out.select("domain", "primary_country", "signal_summary", "last_seen_label", "score_band")


# ------------------------------------------------------------------ raw records: parse, normalize, profile
from scanmart.operators import profiling as P  # noqa: E402
from scanmart.operators import records as R  # noqa: E402
from scanmart.sources import ndjson as N  # noqa: E402
from scanmart.sources import suffixes as PSL  # noqa: E402


def raw_lines(spark, d):
    """Raw NDJSON text of every observation derived from the tables (sequence, value),
    spread over tasks of a bounded number of rows before the (per-row heavy) parsing."""
    return _shared(spark, d, "raw_lines", lambda: record_lines(spark, d))


def raw_variant(spark, d):
    N.allow_duplicate_keys(spark)
    return raw_lines(spark, d).select("sequence", F.parse_json("value").alias("v"))


RECORD_CHECK_COLUMNS = ("observation_id", "timestamp", "ip_str", "hostname", "registrable_domains", "port",
                        "service_category", "country_code", "cloud_present", "cloud_provider", "vuln_count",
                        "vuln_max_cvss", "has_eol_tag", "detected_technologies", "detected_services",
                        "database_service_count", "remote_access_service_count", "canonical_org")


@register("records_observations")
def q_records_observations(spark, d):
    return R.records_to_observations(raw_variant(spark, d), PSL.FIXTURE_RULES).select(*RECORD_CHECK_COLUMNS)


@register("simple_observations")
def q_simple_observations(spark, d):
    s = R.simple_observations(raw_variant(spark, d), PSL.FIXTURE_RULES)
    return s.select("ip", "domains", "hostnames", "registrable_domains", "service_category", "canonical_org", "port",
                    "tags", "cloud", "location", "timestamp")


@register("signal_counts")
def q_signal_counts(spark, d):
    s = R.signal_counts(R.simple_observations(raw_variant(spark, d), PSL.FIXTURE_RULES))
    return s.select("timestamp", "ip", "exposure", "vulnerability", "technology")


@register("registrable_domains")
def q_registrable_domains(spark, d):
    hosts = O.page_hosts(table(spark, d, "pages"))
    h = hosts.select("page_id", "host", R.C.normalize_domain(F.col("host")).alias("_n"))
    return h.select("page_id", "host", PSL.registrable_domain("_n", extra=PSL.FIXTURE_RULES).alias("registrable_domain"))


@register("org_normalize")
def q_org_normalize(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name")
    names = cust.select("c_custkey", F.posexplode(R.C.str_array(O.ADAPTER_ORG_ENDINGS)).alias("variant", "ending"))
    names = names.join(cust, "c_custkey").select("c_custkey", "variant",
                                                 F.concat("c_name", "ending").alias("org"))
    return R.with_canonical_org(names, "org", "canonical_org")


@register("field_presence")
def q_field_presence(spark, d):
    return P.field_presence(raw_variant(spark, d))


@register("field_types")
def q_field_types(spark, d):
    return P.field_types(raw_variant(spark, d))


@register("schema_discovery")
def q_schema_discovery(spark, d):
    return P.schema_discovery(raw_variant(spark, d))


VALUE_TOP_FIELDS = ("ip_str", "port", "org", "tags", "location", "timestamp", "hostnames")


@register("value_top")
def q_value_top(spark, d):
    return P.value_top(raw_variant(spark, d), VALUE_TOP_FIELDS, 10)


@register("org_canonicalization")
def q_org_canonicalization(spark, d):
    return P.org_canonicalization(P.org_aliases(raw_variant(spark, d)))


@register("org_alias_report")
def q_org_alias_report(spark, d):
    return P.top_canonical(P.org_aliases(raw_variant(spark, d)), 10)


@register("port_top")
def q_port_top(spark, d):
    return P.port_top(raw_variant(spark, d), 100)


@register("org_top")
def q_org_top(spark, d):
    return P.org_top(raw_variant(spark, d), 100)


@register("tag_top")
def q_tag_top(spark, d):
    return P.tag_top(raw_variant(spark, d), 100)


@register("list_lengths")
def q_list_lengths(spark, d):
    return P.list_lengths(raw_variant(spark, d))


@register("identity_profile")
def q_identity_profile(spark, d):
    return P.identity_profile(raw_variant(spark, d))


@register("domain_top")
def q_domain_top(spark, d):
    return P.domain_top(raw_variant(spark, d), 30)


@register("technology_presence")
def q_technology_presence(spark, d):
    return P.technology_presence(raw_variant(spark, d))


@register("tech_cooccurrence")
def q_tech_cooccurrence(spark, d):
    return P.technology_cooccurrence(raw_variant(spark, d), 50)


@register("vuln_profile")
def q_vuln_profile(spark, d):
    return P.vuln_profile(raw_variant(spark, d))


@register("vuln_detail_keys")
def q_vuln_detail_keys(spark, d):
    return P.vuln_detail_keys(raw_variant(spark, d), 30)


@register("nested_structure")
def q_nested_structure(spark, d):
    return P.nested_structure(raw_variant(spark, d))


@register("quality_check")
def q_quality_check(spark, d):
    return P.quality_check(observations(spark, d), count_parts=False)


@register("sample_fixed")
def q_sample_fixed(spark, d):
    """500 chat turns, by a seeded hash of their place and text."""
    lines = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("file"), F.col("text").alias("line"))
    return P.sample_fixed(lines, 500, 42)


@register("text_canonical_json")
def q_text_canonical_json(spark, d):
    return raw_lines(spark, d).select("sequence", F.to_json(F.parse_json("value")).alias("canonical_json"))


# ------------------------------------------------------------------ records with every field and odd shapes
from scanmart.plans.lines import record_lines, rich_lines  # noqa: E402


def rich(spark, d):
    """The rich records of all events, parsed."""
    def build():
        N.allow_duplicate_keys(spark)
        return rich_lines(spark, d).select("sequence", F.parse_json("value").alias("v"))
    return _shared(spark, d, "rich", build)


@register("rich_observations")
def q_rich_observations(spark, d):
    """All 64 columns of the curated observation."""
    return R.records_to_observations(rich(spark, d), PSL.FIXTURE_RULES)


RICH_PROFILES = {
    "rich_identity": P.identity_profile, "rich_lengths": P.list_lengths, "rich_pairs": P.technology_cooccurrence,
    "rich_vulns": P.vuln_profile, "rich_nested": P.nested_structure, "list_maxima": P.list_maxima,
    "technologies_above": P.technologies_above, "technology_examples": P.technology_examples,
    "vuln_value_types": P.vuln_value_types, "product_top": P.product_top,
}
for _name, _profile in RICH_PROFILES.items():
    register(_name)(lambda spark, d, f=_profile: f(rich(spark, d)))


@register("alias_lists")
def q_alias_lists(spark, d):
    return P.alias_lists(P.org_aliases(raw_variant(spark, d)), 10)


@register("first_samples")
def q_first_samples(spark, d):
    return P.first_samples(raw_variant(spark, d), 3)


# ------------------------------------------------------------------ evidence, prompts, payloads, shortlists
from scanmart.operators import evidence as EV  # noqa: E402
from scanmart.operators import evals as EVL  # noqa: E402
from scanmart.operators import traces as TR  # noqa: E402
from scanmart.operators import workspace as WS  # noqa: E402

AUDIT_INSTRUCTIONS = "Write a concise technical audit for the account using the evidence."


@register("evidence_pack")
def q_evidence_pack(spark, d):
    ev = EV.evidence_pack(scored(spark, d), EV.account_signal_lists(signals(spark, d), 20), "prospect_audit")
    return ev.select("domain", F.col("evidence.score_reasons").alias("score_reasons"),
                     F.transform("evidence.signals", lambda s: s["name"]).alias("signal_names"),
                     F.size("evidence.constraints").alias("constraint_count"))


@register("prompt_key")
def q_prompt_key(spark, d):
    ev = EV.evidence_pack(scored(spark, d), EV.account_signal_lists(signals(spark, d), 20), "prospect_audit")
    return EV.prompts(ev, AUDIT_INSTRUCTIONS, "audit/v2", "gemini-2.5-flash")


@register("cache_lookup")
def q_cache_lookup(spark, d):
    """Prompts against the responses kept for the accounts of high exposure."""
    requests = q_prompt_key(spark, d)
    high = scored(spark, d).filter("exposure_score >= 50").select("domain")
    kept = requests.join(high, "domain", "left_semi").select("cache_key", F.concat(F.lit("audit of "), "domain").alias("text"))
    return EV.cache_lookup(requests, kept).select("domain", "cached", "cached_text")


def responses_with_fallback(spark, d):
    """Assistant turns as model responses; fallback = first 15 search results for the
    user question just before it (a bounded list per response)."""
    conv = table(spark, d, "conversations")
    sb = q_search_batch(spark, d).filter(F.col("search_rank") <= 15)
    fb = sb.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("search_rank", "domain"))),
                                                   lambda s: s["domain"]).alias("fallback"))
    resp = conv.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("response_id"),
        (F.col("conv_id") * 100000 + F.col("turn") - 1).alias("question_id"), "text")
    return resp.join(fb, "question_id", "left").withColumn(
        "fallback", F.coalesce("fallback", F.array().cast("array<string>")))


def answers(spark, d):
    """The responses as a model would send them: a third with a payload that names known and
    unknown domains, a third with a broken payload, a third plain."""
    r = responses_with_fallback(spark, d)
    payload = F.to_json(F.struct(F.lit("picked").alias("explanation"), F.array(
        F.get("fallback", 1), F.lit("unknown.example.net"), F.get("fallback", 0)).alias("domains")))
    kind = F.floor(F.col("response_id") / 100000) % 3
    tail = F.when(kind == 0, F.concat(F.lit("\n"), payload, F.lit("\n"))).when(kind == 1, '\n{"domains": [}').otherwise("")
    return r.withColumn("text", F.concat("text", tail))


@register("payload_parse")
def q_payload_parse(spark, d):
    return EV.parse_payload(answers(spark, d)).select("response_id", "explanation", "domains")


def allowed_answers(spark, d):
    found = q_search_batch(spark, d).select(
        (F.col("question_id") + 1).alias("response_id"), "domain")
    return EV.allowed_domains(EV.parse_payload(answers(spark, d)), "response_id", found)


@register("allowed_domains")
def q_allowed_domains(spark, d):
    """The domains of each answer that are among its question's search results, else the fallback."""
    return allowed_answers(spark, d).select("response_id", "domains")


@register("shortlist_join")
def q_shortlist_join(spark, d):
    lists = EV.parse_payload(answers(spark, d)).select(F.col("response_id").alias("list_id"), "domains")
    only_unknown = F.array(F.lit("unknown.example.net"))
    lists = lists.withColumn("domains", F.when(F.floor(F.col("list_id") / 100000) % 3 == 1, only_unknown).otherwise(F.col("domains")))
    return SE.shortlist_join(scored(spark, d), lists, "list_id")


# ------------------------------------------------------------------ lexical judge over documents
def judge_cases(spark, d):
    """Every document as a case that is judged under two prompt versions; a language is a run.

    The first version answers with the text, the second with the text and its source."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    toxic = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    versions = F.explode(F.array(
        F.struct(F.lit("audit/v1").alias("prompt_version"), F.col("text")),
        F.struct(F.lit("audit/v2").alias("prompt_version"), F.concat_ws(" ", "text", "source").alias("text"))))
    cases = docs.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("run_id"), versions.alias("r"),
        F.array(F.col("source"), F.lit("the")).alias("must_mention"),
        F.when(F.col("toxic") == 1, F.array(F.lit("password"), F.lit("secret"), F.lit("and")))
         .otherwise(F.array().cast("array<string>")).alias("must_not_mention"))
    return EVL.judge(cases.select("case_id", "run_id", "r.*", "must_mention", "must_not_mention"))


def judge_summary(spark, d):
    return EVL.summarize(judge_cases(spark, d), ["run_id", "prompt_version"])


@register("case_loader")
def q_case_loader(spark, d):
    """The documents' cases written as JSON lines and read with the case loader."""
    run = shared_path(spark, f"cases-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents")
    expected = F.struct(F.array("source", F.lit("the")).alias("must_mention"), F.array(F.lit("password")).alias("must_not_mention"))
    docs.select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.struct(F.col("source").alias("domain")).alias("account"),
                expected.alias("expected"), F.col("text").alias("fixture_output")).write.json(run)
    return EVL.judge(EVL.read_cases(spark, run)).select("case_id", "account.domain", "recall", "passed")


@register("judge_cases")
def q_judge_cases(spark, d):
    return judge_cases(spark, d).select("case_id", "run_id", "prompt_version", "true_positives", "false_negatives",
                                        "false_positives", "precision", "recall", "passed")


@register("judge_summary")
def q_judge_summary(spark, d):
    return judge_summary(spark, d)


@register("judge_delta")
def q_judge_delta(spark, d):
    return EVL.deltas(judge_summary(spark, d))


@register("judge_failures")
def q_judge_failures(spark, d):
    return EVL.failing_cases(judge_cases(spark, d))


# ------------------------------------------------------------------ traces
def traces(spark, d):
    return TR.enrich(TR.with_cost(TR.traces_from_events(table(spark, d, "events")), TR.rates(spark)))


@register("trace_cost")
def q_trace_cost(spark, d):
    return traces(spark, d).select("trace_id", "workflow", "model", "provider", "input_tokens", "output_tokens",
                                   "cost_usd", "decision")


@register("trace_rollup")
def q_trace_rollup(spark, d):
    return TR.rollup(traces(spark, d))


@register("rolling_cost_24h")
def q_rolling_cost(spark, d):
    return TR.rolling_cost(traces(spark, d), 24, 2.0)


# ------------------------------------------------------------------ workspace
def workspace_tables(spark, d):
    cust = table(spark, d, "customer")
    return WS.saved_from_customers(cust), WS.changes_from_orders(table(spark, d, "orders"), cust)


@register("workspace_apply")
def q_workspace_apply(spark, d):
    saved, changes = workspace_tables(spark, d)
    return WS.apply_changes(saved, changes)


@register("workspace_rejects")
def q_workspace_rejects(spark, d):
    _, changes = workspace_tables(spark, d)
    return WS.rejected_updates(changes).select("domain", "seq", "status")


@register("saved_join")
def q_saved_join(spark, d):
    hosts = O.page_hosts(table(spark, d, "pages"))
    saved = hosts.select(F.regexp_extract("host", r"([^.]+\.example\.(com|org|net))$", 1).alias("domain"),
                         "page_id").groupBy("domain").agg(F.min("page_id").cast("string").alias("saved_at")) \
        .withColumn("owner", F.lit(None).cast("string")).withColumn("status", F.lit("New"))
    return WS.saved_join(saved, scored(spark, d)).select("domain", "opportunity_score", "saved_at", "status")


# ------------------------------------------------------------------ streaming (rows-only checks)
import uuid  # noqa: E402

from scanmart.plans.pipeline import build_observations  # noqa: E402
from scanmart.session import shared_path  # noqa: E402
from scanmart.streaming import jobs as ST  # noqa: E402


@register("ingest_observations")
def q_ingest_observations(spark, d):
    """Raw records written as NDJSON files and built into curated observations by the batch job."""
    run = shared_path(spark, f"ingest-{uuid.uuid4().hex}")
    raw_lines(spark, d).select("value").write.mode("overwrite").text(f"{run}/source")
    build_observations(spark, f"{run}/source", f"{run}/observations", extra_rules=PSL.FIXTURE_RULES)
    return spark.read.parquet(f"{run}/observations").select(*RECORD_CHECK_COLUMNS[1:])


@register("stream_ingest")
def q_stream_ingest(spark, d):
    """Raw records written as eight NDJSON files, ingested by a checkpointed stream in three micro-batches."""
    run = shared_path(spark, f"stream-ingest-{uuid.uuid4().hex}")
    raw_lines(spark, d).select("value").repartition(8).write.mode("overwrite").text(f"{run}/source")
    q = ST.ingest(spark, f"{run}/source", f"{run}/observations", f"{run}/checkpoint", max_files=3,
                  extra_rules=PSL.FIXTURE_RULES)
    q.awaitTermination()
    return spark.read.parquet(f"{run}/observations").select(*RECORD_CHECK_COLUMNS[1:])


TRACE_SCHEMA = "trace_id bigint, timestamp timestamp, workflow string, cost_usd double"


@register("stream_cost")
def q_stream_cost(spark, d):
    """Trace rows written as JSON files; 24 h sliding spend per workflow in a stream."""
    run = shared_path(spark, f"stream-cost-{uuid.uuid4().hex}")
    traces(spark, d).select("trace_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "workflow",
                            "cost_usd").write.mode("overwrite").json(f"{run}/source")
    stream = spark.readStream.schema(TRACE_SCHEMA).json(f"{run}/source")
    q = ST.upsert_batches(ST.rolling_cost_stream(stream), f"{run}/windows", f"{run}/checkpoint")
    q.awaitTermination()
    return ST.latest_versions(spark.read.parquet(f"{run}/windows"), ["window_start", "window_end", "workflow"])


# ------------------------------------------------------------------ reads of written marts
def written(spark, d, name, build):
    """A mart written once per session to the shared folder, as the batch job does, and read from there."""
    def make():
        path = shared_path(spark, f"mart-{name}-{uuid.uuid4().hex}")
        build(spark, d).write.parquet(path)
        return spark.read.parquet(path)
    return _shared(spark, d, f"written {name}", make)


@register("read_accounts")
def q_read_accounts(spark, d):
    """All accounts from the written mart."""
    return written(spark, d, "accounts", accounts)


@register("read_account_signals")
def q_read_account_signals(spark, d):
    """The signals of one account, from the written mart: its name is looked up once a session, and the filter reaches the scan."""
    name = _shared(spark, d, "first account", lambda: written(spark, d, "scored", scored).agg(F.min("domain")).first()[0])
    return written(spark, d, "signals", signals).filter(F.col("domain") == F.lit(name))


@register("read_search")
def q_read_search(spark, d):
    """Keyword search over the written scored accounts."""
    found = SE.search_accounts(written(spark, d, "scored", scored), QUESTIONS["search_keyword"], 80)
    return found.select("domain", "opportunity_score")


# ------------------------------------------------------------------ small library forms
@register("opportunity_library")
def q_opportunity_library(spark, d):
    return SC.opportunity_library(scored(spark, d)).select("domain", "opportunity_library_score")


@register("ranked_accounts")
def q_ranked_accounts(spark, d):
    return CX.ranked_accounts(scored(spark, d)).select("domain", "opportunity_score")


@register("clean_technologies")
def q_clean_technologies(spark, d):
    """Technology lists of the raw records with deny-listed and ``_``-prefixed names removed."""
    m = R.vget(F.col("v"), "$", "map<string,variant>")
    keys = F.array_sort(F.coalesce(F.map_keys(m), F.array().cast("array<string>")))
    return raw_variant(spark, d).select("sequence", R.C.clean_technologies(keys).alias("technologies"))


LOOKUP_DOMAIN_RANK = 1


@register("account_lookup")
def q_account_lookup(spark, d):
    """Point lookup of one account and its signals (the first account by score), joined on domain."""
    sc = scored(spark, d)
    key = CX.top_accounts(sc, LOOKUP_DOMAIN_RANK).select("domain")
    sig = signals(spark, d).join(key, "domain", "left_semi")
    return (sc.join(key, "domain", "left_semi")
            .join(sig.select("domain", "signal_name", "severity"), "domain", "left")
            .select("domain", "opportunity_score", "signal_name", "severity"))


@register("eval_totals")
def q_eval_totals(spark, d):
    """Per prompt version: token and cost totals and failing-case count of the judged traces."""
    t = traces(spark, d)
    return (t.groupBy("prompt_version")
            .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                 (F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")) / 1e6).alias("cost_usd"),
                 F.count_if(F.col("error").isNotNull()).alias("failures")))


@register("saved_accounts")
def q_saved_accounts(spark, d):
    saved, changes = workspace_tables(spark, d)
    return WS.list_saved(WS.apply_changes(saved, changes)).select("domain", "saved_at", "status")


@register("cost_model")
def q_cost_model(spark, d):
    return TR.cost_model(traces(spark, d))


# ------------------------------------------------------------------ queries with their SQL beside them
from scanmart.plans import incremental, report_queries, sketch_queries, suffix_cases  # noqa: E402

QUERIES |= suffix_cases.QUERIES | incremental.QUERIES | sketch_queries.QUERIES | report_queries.QUERIES
