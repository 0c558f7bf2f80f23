"""Saved-accounts workspace as table operations: insert-if-absent, update, delete and
an ordered change batch, applied with aggregates instead of a row store.

Sequential semantics per key (equal to applying the changes one by one):
* a delete removes the row; an insert creates it only when absent (defaults, status
  ``New``); an update changes owner/status/notes/next action only when the row exists
  and the status is valid (invalid updates go to the reject output).
* Hence the row is "born" at the first insert after the key's last delete (or exists
  from the start when there is no delete and it was saved before), and carries the
  last valid update after its birth.
Everything is min/max/max_by aggregation per key (map-side combined, so a hot key
costs no more than one partial row per task) and key joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmart.functions import constants as K
from scanmart.sources import buckets

FIELDS = ("owner", "status", "notes", "next_action", "next_action_date")


def _valid_status():
    """Whether a status is one of the allowed ones (null: no)."""
    return F.coalesce(F.col("status").isin(*K.WORKSPACE_STATUSES), F.lit(False))


def rejected_updates(changes: DataFrame) -> DataFrame:
    return changes.filter((F.col("op") == "update") & ~_valid_status())


def apply_changes(saved: DataFrame, changes: DataFrame) -> DataFrame:
    """``saved``: domain, saved_at, owner, status, notes, next_action, next_action_date.
    ``changes``: domain, seq, op (insert/update/delete), changed_at, and the 5 fields."""
    valid = changes.filter((F.col("op") != "update") | _valid_status())
    last_delete = valid.groupBy("domain").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_ld"))
    pre = saved.select("domain", F.lit(True).alias("_pre"))
    keyed = (last_delete.join(pre, "domain", "left")
             .withColumn("_pre", F.coalesce("_pre", F.lit(False))))
    ch = valid.join(keyed, "domain")
    # birth: -1 = the pre-existing row (no delete); else the first insert after the last delete
    after_delete = F.col("seq") > F.coalesce(F.col("_ld"), F.lit(-1))
    births = ch.groupBy("domain", "_ld", "_pre").agg(
        F.min(F.when((F.col("op") == "insert") & after_delete, F.col("seq"))).alias("_first_insert"),
        F.min_by(F.col("changed_at"), F.when((F.col("op") == "insert") & after_delete, F.col("seq")))
         .alias("_born_at"))
    births = births.withColumn(
        "_birth", F.when(F.col("_ld").isNull() & F.col("_pre"), F.lit(-1)).otherwise(F.col("_first_insert")))
    ch2 = ch.join(births.select("domain", "_birth", "_born_at"), "domain")
    upd = (ch2.filter((F.col("op") == "update") & F.col("_birth").isNotNull() & (F.col("seq") > F.col("_birth")))
           .groupBy("domain").agg(F.max_by(F.struct(*FIELDS), F.col("seq")).alias("_u")))
    changed = births.filter(F.col("_birth").isNotNull()).join(upd, "domain", "left").join(
        saved.select("domain", F.col("saved_at").alias("_s_at"),
                     *[F.col(f).alias(f"_s_{f}") for f in FIELDS]), "domain", "left")
    from_saved = F.col("_birth") == -1
    base = {f: F.when(from_saved, F.col(f"_s_{f}")) for f in FIELDS}
    base["status"] = F.when(from_saved, F.col("_s_status")).otherwise(F.lit(K.WORKSPACE_DEFAULT_STATUS))
    resolved = changed.select(
        "domain",
        F.when(from_saved, F.col("_s_at")).otherwise(F.col("_born_at")).alias("saved_at"),
        *[F.when(F.col("_u").isNotNull(), F.col(f"_u.{f}")).otherwise(base[f]).alias(f) for f in FIELDS])
    untouched = saved.join(keyed.select("domain"), "domain", "left_anti")
    return untouched.select("domain", "saved_at", *FIELDS).unionByName(resolved)


ROW_TYPE = "domain string, saved_at string, " + ", ".join(f"{f} string" for f in FIELDS)


def start_workspace(saved: DataFrame, base: str, count: int = buckets.BUCKETS) -> None:
    """``saved`` as a stored workspace in hash buckets of the domain, version 0 (:mod:`scanmart.sources.buckets`)."""
    buckets.start(saved.sparkSession, base)
    written = buckets.write(saved.select("domain", "saved_at", *FIELDS), base, "domain", 0, count)
    buckets.commit(written, base, list(range(count)), 0)


def stored_workspace(spark: SparkSession, base: str) -> DataFrame:
    return buckets.read(spark, base, ROW_TYPE)


def upsert(changes: DataFrame, base: str, version: int, count: int = buckets.BUCKETS) -> int:
    """Applies a change batch to the stored workspace as ``version`` (1, 2, ...); the number of buckets that it rewrote.

    Only the buckets of the changed domains are read and written. A batch whose updates are all
    invalid changes nothing. A version that is applied again after a failure gives the same."""
    spark = changes.sparkSession
    valid = changes.filter((F.col("op") != "update") | _valid_status())
    made = buckets.touched(valid, "domain", count)
    if made:
        old = buckets.read(spark, base, ROW_TYPE, made, version)
        written = buckets.write(apply_changes(old, valid), base, "domain", version, count)
        buckets.commit(written, base, made, version)
    return len(made)


def saved_from_customers(customer: DataFrame) -> DataFrame:
    """Saved rows derived from customers (all text columns, as the workspace stores)."""
    return customer.select(
        customer_domain(F.col("c_name")).alias("domain"),
        F.date_format(F.timestamp_seconds(F.lit(631152000) + F.col("c_custkey")), "yyyy-MM-dd HH:mm:ss")
         .alias("saved_at"),
        F.col("c_mktsegment").alias("owner"),
        F.lit(K.WORKSPACE_DEFAULT_STATUS).alias("status"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("string").alias("next_action"),
        F.lit(None).cast("string").alias("next_action_date"),
    )


def customer_domain(name):
    return F.concat(F.lower(F.regexp_replace(name, "#", "-")), F.lit(".example.com"))


# fixed values of the orders -> changes mapping: priority digit -> status ('5' is invalid)
PRIORITY_STATUS = (("1", "Qualified"), ("2", "Contacted"), ("3", "Meeting booked"), ("4", "Researching"),
                   ("5", "Bogus"))


def changes_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Ordered change batch: O -> insert, F -> update, other -> delete; seq = order key."""
    cust = customer.select("c_custkey", customer_domain(F.col("c_name")).alias("domain"))
    o = orders.join(cust, orders.o_custkey == cust.c_custkey)
    status_map = F.create_map(*[x for kv in PRIORITY_STATUS for x in (F.lit(kv[0]), F.lit(kv[1]))])
    op = F.when(F.col("o_orderstatus") == "O", "insert").when(F.col("o_orderstatus") == "F", "update") \
          .otherwise("delete")
    return o.select(
        "domain", F.col("o_orderkey").alias("seq"), op.alias("op"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("changed_at"),
        F.col("o_orderpriority").alias("owner"),
        F.element_at(status_map, F.substring("o_orderpriority", 1, 1)).alias("status"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("notes"),
        F.lit("follow up").alias("next_action"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("next_action_date"),
    )


def saved_join(saved: DataFrame, scored: DataFrame) -> DataFrame:
    """Saved accounts that exist in the scored mart, in score order."""
    return (scored.join(saved.select("domain", "saved_at", "owner", "status"), "domain")
            .orderBy(F.desc("opportunity_score"), F.asc("domain")))



def list_saved(saved: DataFrame) -> DataFrame:
    """Saved accounts, most recently saved first (ties by domain)."""
    return saved.orderBy(F.desc("saved_at"), F.asc("domain"))
