"""One-pass report sets against the single operators, and the build that sets invalid lines apart."""

import re
import uuid

from pyspark.sql import functions as F

from scanmart.operators import profiling as P
from scanmart.operators import records as R
from scanmart.operators import reports as RP
from scanmart.plans import catalog as CAT
from scanmart.plans import pipeline as PL
from scanmart.plans.lines import rich_lines
from scanmart.session import shared_path
from scanmart.sources import ndjson as N
from scanmart.sources import suffixes as PSL
from tests.conftest import SF

NESTED = dict(
    vulns=P.vuln_profile, vuln_detail_keys=P.vuln_detail_keys, domains_hostnames=P.list_lengths, identity_resolution=P.identity_profile,
    top_domains=P.domain_top, tags_top100=P.tag_top, technologies=P.technology_presence, technology_pairs=P.technology_cooccurrence,
    technologies_above_100=P.technologies_above, technology_examples=P.technology_examples, vuln_value_types=P.vuln_value_types,
    list_maxima=P.list_maxima, ports=P.port_top, organizations=P.org_top, products=P.product_top, nested_fields=P.nested_structure)


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


def odd_records(spark):
    texts = ['{}', '{"vulns":null,"tags":null,"domains":null,"org":null,"port":null}', '{"vulns":{"a":null,"b":{"KEV":1}},"tags":["",null,1.5]}',
             '{"domains":"x","hostnames":{},"org":"","product":0,"port":""}', '{"org":{"a":1},"tags":{},"location":[],"ssl":"s","vulns":[{"kev":1}]}']
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sequence long, value string").select("sequence", F.parse_json("value").alias("v"))


def test_nested_report_equals_the_single_operators(spark):
    for records in (CAT.rich(spark, SF), CAT.raw_variant(spark, SF), odd_records(spark)):
        report = RP.nested_report(records)
        for name, single in NESTED.items():
            same(report[name], single(records))
        assert report["totals"].first()["records"] == records.count()


def test_profile_report_equals_the_single_operators(spark):
    for records in (CAT.raw_variant(spark, SF), CAT.rich(spark, SF), odd_records(spark)):
        report, aliases = RP.profile_report(records), P.org_aliases(records)
        for name, single in dict(field_presence=P.field_presence(records), field_types=P.field_types(records), top_values=P.value_top(records),
                                 organization_canonicalization=P.org_canonicalization(aliases), top_canonical=P.top_canonical(aliases),
                                 aliases=P.alias_lists(aliases)).items():
            same(report[name], single)


def test_reports_of_nothing(spark):
    records = odd_records(spark).limit(0)
    assert RP.profile_report(records)["totals"].first()["records"] == 0
    assert RP.nested_report(records)["list_maxima"].first()["max_domains"] == 0
    assert RP.schema_report(spark.createDataFrame([], "line string"))["lines"].first()["lines"] == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_set_reads_the_records_once(spark, monkeypatch):
    path = shared_path(spark, f"test-once-{uuid.uuid4().hex}")
    CAT.raw_lines(spark, SF).select("value").write.text(path)
    plans, counted = [], RP._counted
    monkeypatch.setattr(RP, "_counted", lambda rows, name: plans.append(plan_of(rows)) or counted(rows, name))
    lines = N.read_lines(spark, path, spread_out=False)
    for make in (lambda: RP.profile_report(N.parse_records(lines, strict=False)), lambda: RP.schema_report(lines),
                 lambda: RP.nested_report(N.parse_records(lines, strict=False), order="file")):
        report = make()
        assert len(plans) == 1 and len(re.findall(r"Relation", plans.pop())) == 1
        assert not any(" text" in plan_of(df) or "parseJson" in plan_of(df) for df in report.values())


def test_invalid_lines_are_set_apart_in_one_write(spark):
    run = shared_path(spark, f"test-quarantine-{uuid.uuid4().hex}")
    good = [r["value"] for r in CAT.raw_lines(spark, SF).orderBy("sequence").limit(60).collect()]
    bad = {0: '{"a":', 7: "[1]", 20: "null", 21: " ", 40: '"x"', 61: "7", 62: '{"a" 1}'}
    lines = list(good)
    for at, line in sorted(bad.items()):
        lines.insert(at, line)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{run}/raw")
    counts = PL.build_with_quarantine(spark, f"{run}/raw", f"{run}/out", rows_per_file=25, extra_rules=PSL.FIXTURE_RULES)
    assert counts == {"records": 60, "invalid_lines": 6}
    numbered = [x for x in lines if x.strip()]
    got = {r["line_number"]: (r["line"], r["reason"]) for r in PL.quarantined(spark, f"{run}/out").collect()}
    assert got == {numbered.index(x): (x, y) for x, y in (
        ('{"a":', "malformed"), ("[1]", "not an object: array"), ("null", "not an object: void"), ('"x"', "not an object: string"),
        ("7", "not an object: bigint"), ('{"a" 1}', "malformed"))}
    # the strict build of the records alone, at their own numbers
    records = spark.createDataFrame([(numbered.index(x), x) for x in good], "sequence long, line string")
    want = R.records_to_observations(N.parse_records(records), PSL.FIXTURE_RULES)
    same(PL.built_observations(spark, f"{run}/out"), want)
    parses = plan_of(N.with_reason(N.numbered_lines(spark, f"{run}/raw")))
    assert parses.count("parseJson") == 1


def test_records_are_taken_apart_only_where_they_are_exploded(spark):
    lines = rich_lines(spark, SF)
    records = lines.select("sequence", F.parse_json("value").alias("v"))
    for facts in (RP.nested_facts(records, "sequence"), records.select(RP.profile_facts(F.col("v")).alias("facts"))):
        plan = plan_of(RP._apart(facts))
        assert plan.count("parseJson") == 1 and "parseJson" not in plan[plan.index("Repartition"):]


def test_facts_taken_apart_without_loss(spark):
    rows = spark.sql("SELECT * FROM VALUES (array(named_struct('report', 'a', 'key', 'k', 'value', null), named_struct('report', 'b', 'key', null, 'value', ''))), "
                     "(array()), (null) AS t(facts)")
    assert sorted(map(tuple, RP._apart(rows).collect())) == [("a", "k", None), ("b", None, "")]
