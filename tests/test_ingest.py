"""No record is lost or numbered twice: large inputs, small micro-batches, replays; silent switches are errors."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from scanmart.functions import columns as C
from scanmart.operators import search as SE
from scanmart.operators import workspace as WS
from scanmart.plans import catalog as CAT
from scanmart.plans import pipeline as PL
from scanmart.session import checkpoint_dir, shared_path
from scanmart.sources import ndjson as N
from scanmart.sources import suffixes as PSL
from scanmart.streaming import jobs as ST
from tests.conftest import SF

LINES = 400_000


def write_lines(spark, path, files):
    """LINES objects and, after every tenth of them, an array, a number and a blank line."""
    record = F.concat(F.lit('{"port":443,"n":'), F.col("id").cast("string"), F.lit(',"ip_str":"198.51.100.'),
                      (F.col("id") % 250).cast("string"), F.lit('","domains":["a.example.com"]}'))
    rows = spark.range(0, LINES, 1, files).select(F.when(F.col("id") % 10 == 0, F.concat(record, F.lit("\\n[1]\\n7\\n \\t"))).otherwise(record))
    rows.write.text(path)


@pytest.mark.parametrize("files", [8, 1])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_large_ingest_keeps_and_numbers_every_record(spark, files, adaptive):
    run = shared_path(spark, f"test-large-{uuid.uuid4().hex}")
    write_lines(spark, f"{run}/raw", files)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(3 << 20))  # several splits of one file
        numbered = N.read_numbered_records(spark, f"{run}/raw").select("sequence", F.try_variant_get("v", "$.n", "long").alias("n"))
        got = numbered.agg(F.count("*"), F.countDistinct("sequence"), F.min("sequence"), F.max("sequence"),
                           F.count_if(F.col("sequence") != F.col("n"))).first()
        assert tuple(got)[:4] == (LINES, LINES, 0, LINES - 1)
        if files == 1:
            assert got[4] == 0  # one file: the numbers are the file's order
        assert PL.build_observations(spark, f"{run}/raw", f"{run}/obs") == LINES
        written = spark.read.parquet(f"{run}/obs").agg(F.count("*"), F.countDistinct("observation_id")).first()
        assert tuple(written) == (LINES, LINES)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def source_files(spark, path, count, seed=4):
    lines = [r["value"] for r in CAT.raw_lines(spark, SF).select("value").collect()]
    random.Random(seed).shuffle(lines)
    os.makedirs(path)
    for i in range(count):
        with open(f"{path}/{i}.ndjson", "w") as f:
            f.write("\n".join(lines[i::count]) + "\n")
    return lines


def ingest(spark, run, **options):
    ST.ingest(spark, f"{run}/src", f"{run}/obs", f"{run}/ckpt", extra_rules=PSL.FIXTURE_RULES, **options).awaitTermination()
    return spark.read.parquet(f"{run}/obs")


def test_stream_in_small_unordered_batches_equals_batch(spark):
    run = shared_path(spark, f"test-small-{uuid.uuid4().hex}")
    lines = source_files(spark, f"{run}/src", 8)
    out = ingest(spark, run, max_files=2)
    assert out.count() == out.select("observation_id").distinct().count() == len(lines) == 1000
    columns = [c for c in CAT.RECORD_CHECK_COLUMNS if c != "observation_id"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows(out) == rows(CAT.q_records_observations(spark, SF))
    os.link(f"{run}/src/3.ndjson", f"{run}/src/renamed.ndjson")  # a replay under another name
    assert ingest(spark, run, max_files=2).count() == 1000


def test_equal_lines_of_one_file_stay_apart(spark):
    run = shared_path(spark, f"test-equal-{uuid.uuid4().hex}")
    os.makedirs(f"{run}/src")
    line = json.dumps({"ip_str": "198.51.100.9", "port": 80})
    for name in ("a", "copy"):
        with open(f"{run}/src/{name}.ndjson", "w") as f:
            f.write("\n".join([line, line, "[]", "oops"]) + "\n")
    assert ingest(spark, run, max_files=1).count() == 2
    assert N.read_numbered_records(spark, f"{run}/src/a.ndjson", strict=False).count() == 2


def test_of_equal_keys_the_last_counts(spark):
    lines = spark.createDataFrame([('{"a":1,"a":2}',)], "line string")
    assert N.parse_records(lines).select(F.try_variant_get("v", "$.a", "int")).first()[0] == 2


def test_json_truthiness(spark):
    values = ['"0"', '"0.0"', '""', "0", "0.0", "1", "-0.5", "true", "false", "null", "[]", "[null]", "[0]", "{}", '{"a":null}', '"false"']
    df = spark.createDataFrame([(v,) for v in values], "t string").withColumn("v", F.parse_json("t"))
    got = {r["t"]: r["b"] for r in df.select("t", C.json_truthy(F.col("v")).alias("b")).collect()}
    assert got == {v: bool(json.loads(v)) for v in values}
    missing = df.limit(1).select(C.json_truthy(F.try_variant_get("v", "$.x", "variant"))).first()[0]
    assert missing is False


def test_domains_lose_white_space_of_any_kind(spark):
    cases = {"\texample.com\n": "example.com", "\u00a0www.a.org.\r\n": "a.org", "\t\n": None, "b.net\x0b": "b.net"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["r"] for r in df.select("x", C.normalize_domain("x").alias("r")).collect()} == cases


def test_international_suffixes(spark):
    hosts = {"shop.xn--e1afmkfd.xn--p1ai": "xn--e1afmkfd.xn--p1ai", "shop.пример.рф": "пример.рф"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r["h"]: r["r"] for r in df.select("h", PSL.registrable_domain("h").alias("r")).collect()} == hosts


def test_the_suffix_list_comes_with_the_package(monkeypatch, tmp_path):
    monkeypatch.delenv("SCANMART_SUFFIX_LIST", raising=False)
    import pyspark

    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "nowhere" / "__init__.py"))  # Spark's own jars are hidden
    assert "co.uk" in PSL._list_text().splitlines()


def test_a_missing_suffix_list_is_an_error(monkeypatch, tmp_path):
    monkeypatch.setenv("SCANMART_SUFFIX_LIST", str(tmp_path / "no.dat"))
    with pytest.raises(FileNotFoundError):
        PSL._list_text()


def test_no_machine_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster)


def test_updates_without_a_status_are_rejected(spark):
    fields = "owner string, status string, notes string, next_action string, next_action_date string"
    changes = spark.createDataFrame(
        [("a", 1, "insert", "t", None, None, None, None, None), ("a", 2, "update", "t", "o", None, None, None, None)],
        f"domain string, seq long, op string, changed_at string, {fields}")
    assert [r["seq"] for r in WS.rejected_updates(changes).collect()] == [2]
    saved = spark.createDataFrame([], f"domain string, saved_at string, {fields}")
    assert [(r["domain"], r["owner"]) for r in WS.apply_changes(saved, changes).collect()] == [("a", None)]


def test_a_shortlist_without_known_domains_shows_all_matches(spark):
    matches = spark.createDataFrame([(f"d{i}", float(i)) for i in range(500)], "domain string, opportunity_score double")
    lists = spark.createDataFrame([(1, ["d3", "zz", "d1", "d3"]), (2, ["zz"]), (3, [])], "list_id long, domains array<string>")
    joined = SE.shortlist_join(matches, lists)
    assert [r["domain"] for r in SE.shown(matches, joined, 1).collect()] == ["d3", "d1"]
    for k in (2, 3):
        assert [r["domain"] for r in SE.shown(matches, joined, k).collect()] == [f"d{i}" for i in range(499, -1, -1)]
