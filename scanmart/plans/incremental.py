"""Queries of tables that are kept up to date by small batches, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmart.operators import observations as O
from scanmart.operators import workspace as WS
from scanmart.plans import oracle
from scanmart.plans.lines import record_lines
from scanmart.session import shared_path
from scanmart.sources import suffixes as PSL
from scanmart.sources.tables import table
from scanmart.streaming import jobs as ST


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return O.adapter_observations(table(spark, d, "events"), table(spark, d, "pages"), table(spark, d, "nation"))


#: Files of the replay query; every file has the greeting lines, and one file comes twice.
FILES, REPLAYED = 6, 2
GREETING = '{"ip_str":"198.51.100.7","port":443,"domains":["greeting.example.org"]}'


def stream_replays(spark: SparkSession, d: str) -> DataFrame:
    """Records in files that share lines, one of them replayed under another name, ingested by a stream: ports by IP.

    Every file has two equal greeting lines: equal lines of a file and of different files are all
    kept. The replay comes in another order of lines and in a later micro-batch or the same."""
    run = shared_path(spark, f"replays-{uuid.uuid4().hex}")
    lines = record_lines(spark, d).select((F.col("sequence") % FILES).alias("part"), "value")
    greetings = spark.range(2 * FILES).select((F.col("id") % FILES).alias("part"), F.lit(GREETING).alias("value"))
    files = lines.unionByName(greetings)
    # a folder a file: each is read as one file of the stream
    files.repartition("part").write.partitionBy("part").text(f"{run}/all")
    again = spark.read.text(f"{run}/all/part={REPLAYED}").orderBy(F.desc("value")).coalesce(1)
    again.write.text(f"{run}/all/part={FILES}")
    q = ST.ingest(spark, f"{run}/all/part=*", f"{run}/observations", f"{run}/checkpoint", max_files=2, extra_rules=PSL.FIXTURE_RULES)
    q.awaitTermination()
    return spark.read.parquet(f"{run}/observations").groupBy("ip_str", "port").agg(
        F.count("*").alias("observations"), F.countDistinct("observation_id").alias("ids"))


def stream_accounts(spark: SparkSession, d: str) -> DataFrame:
    """The accounts as a stream keeps them that takes the observations in several micro-batches."""
    run = shared_path(spark, f"stream-accounts-{uuid.uuid4().hex}")
    _observations(spark, d).drop("user_id", "k").repartition(8).write.parquet(f"{run}/source")
    schema = spark.read.parquet(f"{run}/source").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{run}/source")
    ST.refresh_accounts(spark, f"{run}/accounts", f"{run}/checkpoint", source, count=16).awaitTermination()
    return ST.latest_accounts(spark, f"{run}/accounts")


UPSERTS = 3


def workspace_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stored workspace after the ordered changes came in several batches, each rewriting the buckets it touches."""
    base = shared_path(spark, f"workspace-{uuid.uuid4().hex}")
    customer = table(spark, d, "customer")
    WS.start_workspace(WS.saved_from_customers(customer), base, 16)
    changes = WS.changes_from_orders(table(spark, d, "orders"), customer)
    last = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    for k in range(UPSERTS):
        low, high = (last + 1) * k // UPSERTS, (last + 1) * (k + 1) // UPSERTS
        WS.upsert(changes.where((F.col("seq") >= low) & (F.col("seq") < high)), base, k + 1, 16)
    return WS.stored_workspace(spark, base)


QUERIES = {f.__name__: f for f in (stream_replays, stream_accounts, workspace_upsert)}


def sql(known: dict[str, str]) -> dict[str, str]:
    """The SQL, from that of the batch forms."""
    return {
        "stream_replays": oracle.with_ctes(oracle.ADAPTER) + f"""
, r AS (SELECT ip_str, port FROM obs UNION ALL SELECT '198.51.100.7', 443 FROM range({2 * FILES}))
SELECT ip_str, port, count(*) AS observations, count(*) AS ids FROM r GROUP BY ALL""",
        "stream_accounts": known["accounts_mart"],
        "workspace_upsert": known["workspace_apply"],
    }
