"""Streams and upserts: what is kept, what is left alone, and a batch that is run again."""

import glob
import json
import os
import uuid

from pyspark.sql import functions as F

from scanmart.operators import marts as M
from scanmart.operators import workspace as WS
from scanmart.plans import catalog as CAT
from scanmart.session import shared_path
from scanmart.sources import buckets
from scanmart.streaming import jobs as ST
from tests.conftest import SF


def plain(df, *columns):
    return sorted(map(repr, df.select(*columns).collect() if columns else df.collect()))


def write_lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def record(i):
    return json.dumps({"ip_str": f"198.51.100.{i}", "port": i, "domains": ["a.example.com"]})


def ingest(spark, run, name="ckpt", **options):
    ST.ingest(spark, f"{run}/src", f"{run}/obs", f"{run}/{name}", **options).awaitTermination()
    return spark.read.parquet(f"{run}/obs")


def rerun_last_batch(checkpoint):
    """As if the stream had failed before it committed its last batch."""
    last = max(int(os.path.basename(x)) for x in glob.glob(f"{checkpoint}/commits/*"))
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_files_are_replays_by_content(spark):
    run = shared_path(spark, f"test-replay-{uuid.uuid4().hex}")
    a, b = [record(1), record(2), "oops", record(1)], [record(1), record(3), "[]"]
    write_lines(f"{run}/src/a.ndjson", a)
    write_lines(f"{run}/src/b.ndjson", b)  # shares a line with a
    write_lines(f"{run}/src/c.ndjson", a[::-1])  # a in another order
    out = ingest(spark, run)
    assert sorted(r["port"] for r in out.collect()) == [1, 1, 1, 2, 3]
    assert out.select("observation_id").distinct().count() == 5
    write_lines(f"{run}/src/d.ndjson", a)  # a again, in a later batch
    write_lines(f"{run}/src/e.ndjson", [*a, record(4)])  # all of a and a line more
    out = ingest(spark, run)
    assert sorted(r["port"] for r in out.collect()) == [1] * 5 + [2, 2, 3, 4]
    # a stream of its own on the same sink knows the files too
    assert ingest(spark, run, "other").count() == 9


def test_a_batch_that_is_run_again_adds_nothing(spark):
    run = shared_path(spark, f"test-rerun-{uuid.uuid4().hex}")
    for i in range(4):
        write_lines(f"{run}/src/{i}.ndjson", [record(i), record(9)])
    before = plain(ingest(spark, run, max_files=2))
    assert len(before) == 8
    rerun_last_batch(f"{run}/ckpt")
    assert plain(ingest(spark, run, max_files=2)) == before
    assert spark.read.parquet(f"{run}/obs-files").where("batch >= 0").count() == 4


def test_replays_are_found_without_the_sink(spark):
    run = shared_path(spark, f"test-sink-{uuid.uuid4().hex}")
    write_lines(f"{run}/src/0.ndjson", [record(1)])
    ingest(spark, run)
    for path in glob.glob(f"{run}/obs/*/batch=0/*.parquet"):
        with open(path, "wb") as f:
            f.write(b"not read")
    write_lines(f"{run}/src/1.ndjson", [record(1)])
    write_lines(f"{run}/src/2.ndjson", [record(2)])
    ST.ingest(spark, f"{run}/src", f"{run}/obs", f"{run}/ckpt").awaitTermination()
    assert [r["port"] for r in spark.read.parquet(*glob.glob(f"{run}/obs/*/batch=1")).collect()] == [2]


def listed(base):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{base}/**/*.parquet", recursive=True)}


def test_accounts_refresh_rewrites_touched_buckets_only(spark):
    run = shared_path(spark, f"test-accounts-{uuid.uuid4().hex}")
    obs = CAT.observations(spark, SF).drop("user_id", "k")
    obs.repartition(4).write.parquet(f"{run}/src")

    def refresh():
        source = spark.readStream.schema(spark.read.parquet(f"{run}/src").schema).option("maxFilesPerTrigger", 3).parquet(f"{run}/src")
        ST.refresh_accounts(spark, f"{run}/acc", f"{run}/ckpt", source, count=32).awaitTermination()
        return ST.latest_accounts(spark, f"{run}/acc")

    assert plain(refresh()) == plain(M.accounts_mart(spark.read.parquet(f"{run}/src")))
    before, newest = listed(f"{run}/acc/rows") | listed(f"{run}/acc/accounts"), buckets.newest(spark, f"{run}/acc")
    # one domain more, seen in new places
    one = obs.where(F.array_contains("registrable_domains", obs.first()["registrable_domains"][0])).limit(5)
    one.withColumn("ip_str", F.concat(F.lit("203.0.113."), "event_id")).withColumn("registrable_domains", F.slice(
        F.array_intersect("registrable_domains", F.array(F.lit(obs.first()["registrable_domains"][0]))), 1, 1)).coalesce(1).write.mode("append").parquet(f"{run}/src")
    assert plain(refresh()) == plain(M.accounts_mart(spark.read.parquet(f"{run}/src")))
    after = listed(f"{run}/acc/rows") | listed(f"{run}/acc/accounts")
    assert {p: t for p, t in after.items() if p in before} == before
    changed = {k for k, v in buckets.newest(spark, f"{run}/acc").items() if v != newest.get(k)}
    assert len(changed) == 1 and {p.split("bucket=")[1].split("/")[0] for p in after.keys() - before.keys()} == {str(*changed)}
    rerun_last_batch(f"{run}/ckpt")
    assert plain(refresh()) == plain(M.accounts_mart(spark.read.parquet(f"{run}/src")))


def test_upsert_equals_one_batch_and_leaves_other_buckets(spark):
    base = shared_path(spark, f"test-upsert-{uuid.uuid4().hex}")
    saved, changes = CAT.workspace_tables(spark, SF)
    WS.start_workspace(saved, base, 16)
    assert plain(WS.stored_workspace(spark, base), "domain", "status") == plain(saved, "domain", "status")
    some = changes.where("seq % 3 = 0 and domain < 'customer-000000050'")
    rest = changes.join(some.select("domain").distinct(), "domain", "left_anti").where("domain > 'customer-000000100'").orderBy("domain").limit(6)
    before = listed(f"{base}/rows")
    assert WS.upsert(some, base, 1, 16) == len(buckets.touched(some.where("op <> 'update' or status <> 'Bogus'"), "domain", 16))
    want = WS.apply_changes(saved, some)
    assert plain(WS.stored_workspace(spark, base)) == plain(want)
    assert WS.upsert(rest, base, 2, 16) <= 6
    assert WS.upsert(rest, base, 2, 16) <= 6  # applied again
    want = WS.apply_changes(want, rest)
    assert plain(WS.stored_workspace(spark, base)) == plain(want)
    assert {p: t for p, t in listed(f"{base}/rows").items() if p in before} == before
    # a bucket that loses all its rows
    gone = WS.stored_workspace(spark, base).select(
        "domain", F.lit(10 ** 9).cast("long").alias("seq"), F.lit("delete").alias("op"), F.lit("t").alias("changed_at"),
        *(F.lit(None).cast("string").alias(f) for f in WS.FIELDS))
    WS.upsert(gone.where(buckets.bucket_of("domain", 16) < 15), base, 3, 16)
    assert {r["b"] for r in WS.stored_workspace(spark, base).select(buckets.bucket_of("domain", 16).alias("b")).collect()} <= {15}
    bad = gone.limit(2).withColumn("op", F.lit("update")).withColumn("status", F.lit("Bogus"))
    assert WS.upsert(bad, base, 4, 16) == 0
