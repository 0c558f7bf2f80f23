"""Report sets, the tolerant ingest and the JSON sinks as queries, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmart.functions import constants as K
from scanmart.operators import observations as O
from scanmart.operators import reports as RP
from scanmart.plans import pipeline as PL
from scanmart.plans import rich, sketch_queries
from scanmart.plans.lines import dealt_events, record_lines, rich_lines
from scanmart.session import shared_path
from scanmart.sources import ndjson as N
from scanmart.sources import sinks
from scanmart.sources import suffixes as PSL
from scanmart.sources.tables import table


#: Lines that hold no record: one for each event whose number leaves this rest when divided by 40.
BROKEN = ((0, '{"ip_str":'), (1, "[1,2]"), (2, "17"), (3, '"text"'), (4, "null"), (5, "not json"), (6, "true"), (7, "2.5"))
_REASONS = ("malformed", "not an object: array", "not an object: bigint", "not an object: string", "not an object: void", "malformed",
            "not an object: boolean", "not an object: decimal")


def _with_broken(spark: SparkSession, d: str) -> DataFrame:
    """(part, value): the records' lines, broken ones and blank ones."""
    e = F.col("event_id")
    broken = F.create_map(*(F.lit(x) for pair in BROKEN for x in pair))[(e % 40).cast("int")]
    more = dealt_events(spark, d).select(e, F.explode(F.array(broken, F.when(e % 40 == 9, F.lit(" \t")))).alias("value")).where("value is not null")
    lines = record_lines(spark, d).select(F.col("sequence").alias("event_id"), "value").unionByName(more)
    return lines.select((e % 4).alias("part"), "value")


def profile_report(spark: SparkSession, d: str) -> DataFrame:
    records = record_lines(spark, d).select("sequence", F.parse_json("value").alias("v"))
    return RP.as_table(RP.profile_report(records))


def nested_report(spark: SparkSession, d: str) -> DataFrame:
    """The nested-field report over all rich records."""
    N.allow_duplicate_keys(spark)
    return RP.as_table(RP.nested_report(rich_lines(spark, d).select("sequence", F.parse_json("value").alias("v"))))


def schema_report(spark: SparkSession, d: str) -> DataFrame:
    """Keys, types and invalid lines of lines that are not all records."""
    lines = _with_broken(spark, d).where(F.col("value").rlike(r"\S"))
    return RP.as_table(RP.schema_report(lines.select(F.col("value").alias("line"))))


def ingest_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Lines without a record, as the one-pass build sets them apart; the file is known by its folder."""
    run = shared_path(spark, f"quarantine-{uuid.uuid4().hex}")
    _with_broken(spark, d).write.partitionBy("part").text(f"{run}/source")
    PL.build_with_quarantine(spark, f"{run}/source", f"{run}/out", extra_rules=PSL.FIXTURE_RULES)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("int")
    return PL.quarantined(spark, f"{run}/out").select(part.alias("part"), "line", "reason")


def ingest_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """What the same build makes of the records, by service: rows, domains and vulnerabilities."""
    run = shared_path(spark, f"tolerant-{uuid.uuid4().hex}")
    _with_broken(spark, d).write.partitionBy("part").text(f"{run}/source")
    counts = PL.build_with_quarantine(spark, f"{run}/source", f"{run}/out", extra_rules=PSL.FIXTURE_RULES)
    rows = PL.built_observations(spark, f"{run}/out").groupBy("service_category").agg(
        F.count("*").alias("observations"), F.countDistinct("observation_id").alias("ids"),
        F.sum(F.size("registrable_domains")).alias("domains"), F.sum("vuln_count").alias("vulns"))
    return rows.select("*", *(F.lit(counts[k]).cast("bigint").alias(k) for k in ("records", "invalid_lines")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    from scanmart.plans.catalog import scored

    return scored(spark, d)


def context_documents(spark: SparkSession, d: str) -> DataFrame:
    """The account contexts written as JSON lines and read back."""
    from scanmart.operators import context as CX
    from scanmart.plans.catalog import context

    run = shared_path(spark, f"context-{uuid.uuid4().hex}")
    written = sinks.write_jsonl(CX.context_json(context(spark, d)), run, column="context")
    docs = spark.read.schema("account struct<domain:string,account_id:string>, metrics struct<observation_count:bigint>, "
                             "scores struct<opportunity_score:double>, signals array<struct<signal_name:string>>, "
                             "evidence array<struct<observation_id:string>>").json(run)
    return docs.select(F.col("account.domain").alias("domain"), F.col("metrics.observation_count").alias("observation_count"),
                       F.col("scores.opportunity_score").alias("opportunity_score"), F.col("signals.signal_name").alias("signal_names"),
                       F.size("evidence").alias("evidence"), F.lit(written).cast("bigint").alias("documents"))


def report_set(spark: SparkSession, d: str) -> DataFrame:
    """The schema report written as a set of JSON reports, and what each holds when read back."""
    run = shared_path(spark, f"reports-{uuid.uuid4().hex}")
    lines = _with_broken(spark, d).where(F.col("value").rlike(r"\S"))
    counts = sinks.write_reports(RP.schema_report(lines.select(F.col("value").alias("line"))), run)
    keys = spark.read.schema("key string, value_type string, records bigint").json(f"{run}/keys")
    totals = spark.read.schema("lines bigint, records bigint, invalid_lines bigint").json(f"{run}/lines")
    keys = keys.agg(F.lit("keys").alias("report"), F.lit(counts["keys"]).cast("bigint").alias("entries"), F.sum("records").alias("amount"))
    return keys.unionByName(totals.select(F.lit("lines").alias("report"), F.lit(counts["lines"]).cast("bigint").alias("entries"), F.col("lines").alias("amount")))


def trace_append(spark: SparkSession, d: str) -> DataFrame:
    """Traces appended in two deliveries to one JSON-lines log, the second without times, read back by workflow."""
    from scanmart.plans.catalog import traces

    run = shared_path(spark, f"traces-{uuid.uuid4().hex}")
    rows = traces(spark, d).select("trace_id", "timestamp", "workflow", "cost_usd", "error")
    sinks.append_traces(rows.where("trace_id % 2 = 0"), run)
    sinks.append_traces(rows.where("trace_id % 2 = 1").drop("timestamp"), run)
    log = spark.read.schema("trace_id bigint, timestamp string, workflow string, cost_usd double, error string").json(run)
    return log.groupBy("workflow").agg(F.count("*").alias("calls"), F.count_if(F.length("timestamp") > 0).alias("with_time"),
                                       F.count("error").alias("errors"), F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")).alias("micros"))


def overwritten_parts(spark: SparkSession, d: str) -> DataFrame:
    """Observations written over an earlier write, in parts of bounded size: what is read, and the rows that the writes counted."""
    run = shared_path(spark, f"overwritten-{uuid.uuid4().hex}")
    obs = O.adapter_observations(table(spark, d, "events"), table(spark, d, "pages"), table(spark, d, "nation")).drop("user_id", "k")
    first = sinks.write_parquet(obs.where("port = 443"), run, rows_per_file=100)
    second = sinks.write_parquet(obs, run, rows_per_file=1000)
    rows = spark.read.parquet(run)
    largest = rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    return rows.groupBy("service_category").agg(F.count("*").alias("observations")).crossJoin(F.broadcast(largest)).select(
        "service_category", "observations", F.lit(first).cast("bigint").alias("first_write"), F.lit(second).cast("bigint").alias("second_write"),
        (F.col("n") <= 1000).alias("within_part_size"))


def record_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Records that the throughput measurement of the tolerant reader counts in files with broken lines."""
    run = shared_path(spark, f"throughput-{uuid.uuid4().hex}")
    _with_broken(spark, d).select("value").write.text(run)
    found = PL.throughput(spark, run)
    rate = found["records"] / found["elapsed_seconds"] if found["elapsed_seconds"] else 0.0
    return spark.range(1).select(F.lit(found["records"]).cast("bigint").alias("records"), F.lit(rate > 0).alias("measured"))


QUERIES = {f.__name__: f for f in (profile_report, nested_report, schema_report, ingest_quarantine, ingest_tolerant, context_documents,
                                   report_set, trace_append, overwritten_parts, record_throughput)}


def _table(parts: dict[str, tuple[str, list[str], list[str]]]) -> str:
    """The SQL of a report set: report -> (SQL, label columns, measures)."""
    out = []
    for report, (sql, labels, measures) in parts.items():
        label = f"concat_ws(' | ', {', '.join(labels)})" if labels else "''"
        for m in measures:
            out.append(f"SELECT '{report}' AS report, {label} AS label, '{m}' AS measure, CAST({m} AS DOUBLE) AS amount FROM ({sql})")
    return "\nUNION ALL ".join(out)


def sql(known: dict[str, str]) -> dict[str, str]:
    rows, ranked = ["records"], ["rank", "records"]
    values = sketch_queries.sql(known)["value_top_bounded"].split(",\n  count(*) OVER (PARTITION BY field) AS different")[0]
    values += f" FROM c)\nSELECT field, value, records, rank FROM r WHERE rank <= 10"
    over = lambda q: "WITH" + rich._RICH.join([" ", ""]) + "\n" + q
    top = lambda q, key, k: over(rich._ranked(q, key, k))
    events = "SELECT count(*) AS records FROM events"
    domains = """SELECT domain, count(*) AS records FROM (
      SELECT 'googleusercontent.com' AS domain FROM rich WHERE e % 5 = 0
      UNION ALL SELECT 'a' || (e % 7) || '.example.com.' || chr(9) FROM rich WHERE e % 5 = 2
      UNION ALL SELECT unnest(['b.example.org', 'none']) FROM rich WHERE e % 5 = 2
      UNION ALL SELECT 'c' || (e % 9) || '.example.net' FROM rich WHERE e % 5 = 3) GROUP BY domain"""
    tags = """SELECT tag, count(*) AS records FROM (SELECT unnest(CASE e % 4 WHEN 0 THEN ['eol-os', 'x'] WHEN 2 THEN ['1'] END) AS tag FROM rich) GROUP BY tag"""
    keys = """SELECT key, count(*) AS records FROM (SELECT unnest(CASE e % 6 WHEN 0 THEN ['cvss', 'kev'] WHEN 2 THEN ['cvss_v2', 'note'] END) AS key FROM rich) GROUP BY key"""
    ports = f"SELECT port, count(*) AS records FROM (SELECT {rich._PORT_TEXT} AS port FROM rich) GROUP BY port"
    orgs = "SELECT org, count(*) AS records FROM (SELECT CASE WHEN e % 2 = 0 THEN 'Org ' || (e % 8) || ' GmbH & Co' ELSE '5' END AS org FROM rich) GROUP BY org"
    techs = f"SELECT technology, count(*) AS records FROM (SELECT unnest({rich._TECHS}) AS technology FROM rich) GROUP BY technology"
    broken = ", ".join(f"({rest}, '{line}', '{reason}')" for (rest, line), reason in zip(BROKEN, _REASONS))
    bad = f"""bad AS (SELECT CAST(event_id % 4 AS INTEGER) AS part, b.line, b.reason FROM events JOIN (VALUES {broken}) b(rest, line, reason) ON event_id % 40 = rest)"""
    invalid = f"WITH {bad} SELECT (SELECT count(*) FROM events) AS records, count(*) AS invalid_lines, (SELECT count(*) FROM events) + count(*) AS lines FROM bad"
    schema = {"keys": (known["schema_discovery"], ["key", "value_type"], rows), "lines": (invalid, [], ["invalid_lines", "lines", "records"])}
    head = known["records_observations"].split("SELECT observation_id")[0]
    ctx = known["account_context"].rsplit("SELECT sel.domain", 1)[0]
    traces = known["trace_cost"].rsplit("SELECT trace_id", 1)[0]
    return {
        "profile_report": _table({
            "totals": (events, [], rows), "field_presence": (known["field_presence"], ["field"], ["missing", "present"]),
            "field_types": (known["field_types"], ["field", "value_type"], rows), "top_values": (values, ["field", "value"], ranked),
            "organization_canonicalization": (known["org_canonicalization"], [], ["canonical_unique", "merged_records", "raw_unique"]),
            "top_canonical": (known["org_alias_report"], ["canonical"], ["aliases", *ranked]),
            "aliases": (known["alias_lists"], ["alias", "canonical"], ranked)}),
        "nested_report": _table({
            "totals": (events, [], rows), "vulns": (known["rich_vulns"], [], list(RP.VULNS)), "vuln_detail_keys": (top(keys, "key", 30), ["key"], ranked),
            "domains_hostnames": (known["rich_lengths"], ["list"], ["length", "records"]),
            "identity_resolution": (known["rich_identity"], [], [*RP.IDENTITY, "estimated_domain_coverage"]),
            "top_domains": (top(domains, "domain", 30), ["domain"], ranked), "tags_top100": (top(tags, "tag", 100), ["tag"], ranked),
            "technologies": (over(techs), ["technology"], rows), "technology_pairs": (known["rich_pairs"], ["pair"], ranked),
            "technologies_above_100": (known["technologies_above"], ["technology"], ["candidate_count", "records"]),
            "technology_examples": (known["technology_examples"], ["array_to_string(technologies, ',')"], ["sequence"]),
            "vuln_value_types": (known["vuln_value_types"], ["value_type"], rows), "list_maxima": (known["list_maxima"], [], ["max_domains", "max_hostnames"]),
            "ports": (top(ports, "port", 100), ["port"], ranked), "organizations": (top(orgs, "org", 100), ["org"], ranked),
            "products": (known["product_top"], ["product"], ranked), "nested_fields": (known["rich_nested"], ["field", "key"], rows)}),
        "schema_report": _table(schema),
        "ingest_quarantine": f"WITH {bad} SELECT part, line, reason FROM bad",
        "ingest_tolerant": head.rstrip() + f"""
, {bad}, n AS (SELECT count(*) AS invalid_lines FROM bad)
SELECT service_category, count(*) AS observations, count(*) AS ids, CAST(sum(len(registrable_domains)) AS BIGINT) AS domains,
  CAST(sum(vuln_count) AS BIGINT) AS vulns, (SELECT count(*) FROM obs_orgs) AS records, any_value(invalid_lines) AS invalid_lines
FROM obs_orgs, n GROUP BY service_category""",
        "context_documents": ctx + """
SELECT sel.domain, observation_count, opportunity_score,
  coalesce((SELECT list(signal_name ORDER BY severity, signal_name) FROM signals s WHERE s.domain = sel.domain), CAST([] AS VARCHAR[])) AS signal_names,
  CAST(coalesce(len(evd.ids), 0) AS INTEGER) AS evidence, (SELECT count(*) FROM sel) AS documents
FROM sel LEFT JOIN evd ON evd.domain = sel.domain""",
        "report_set": f"""
SELECT 'keys' AS report, count(*) AS entries, CAST(sum(records) AS BIGINT) AS amount FROM ({known["schema_discovery"]})
UNION ALL SELECT 'lines', 1, lines FROM ({invalid})""",
        "overwritten_parts": known["observations"].split("SELECT * EXCLUDE")[0] + """
SELECT service_category, count(*) AS observations, (SELECT count(*) FROM obs WHERE port = 443) AS first_write,
  (SELECT count(*) FROM obs) AS second_write, true AS within_part_size FROM obs GROUP BY service_category""",
        "record_throughput": "SELECT count(*) AS records, true AS measured FROM events",
        "trace_append": traces + """
SELECT workflow, count(*) AS calls, count(*) AS with_time, count(error) AS errors, CAST(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS BIGINT) AS micros
FROM tr GROUP BY workflow""",
    }
