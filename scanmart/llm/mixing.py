"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

The mix is a number of equal-token blocks. Sources get blocks by the highest quotients
target / (2k + 1); a source's blocks are apportioned in the same way to its groups of
shards and to its shards by their sizes, which gives an integer quota per shard. A shard's
documents, in an order drawn from a seed, form a stream that is read at most twice; its
quota is that many blocks from the start of the stream.

Shards have a bounded size, so that a hot source is many window partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SPACE, stored

BLOCK = 16
SHARD_WORDS = 1 << 18
GROUP_SHARDS = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"[^{WORD_SPACE}]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, sid, source_size, target) for each source of ``sizes`` (source, size).

    Sources by code point, null last, take the weights in turn and share ``share`` times
    all sizes; a target stops at ``most`` times its source's size and the excess is shared
    anew by weight. The windows are over one row per source.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    rows = rows.withColumn("sid", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("sid"), F.lit(len(weights)))))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    # by rising cap per weight, a source is capped if the level before it reaches its cap
    before = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    total, weight = F.lit(share) * F.sum("source_size").over(everything), F.sum("weight").over(everything)
    rows = rows.select(
        "*", total.alias("total"), weight.alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    rows = rows.withColumn("capped", F.col("cap") <= level * F.col("weight"))
    done = lambda name: F.sum(F.when(F.col("capped"), F.col(name)).otherwise(0)).over(everything)
    rows = rows.select("*", done("cap").alias("cap_done"), done("weight").alias("weight_done"))
    left = (F.col("total") - F.col("cap_done")) / F.nullif(F.col("all_weight") - F.col("weight_done"), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * left)
    return rows.select("source", F.col("sid").cast("long").alias("sid"), "source_size", target.alias("target"))


def apportioned(rows: DataFrame, share: str, seats: str, by: list[str], order: str) -> DataFrame:
    """``rows`` with ``quota``: the ``seats`` of each group ``by`` dealt by highest quotients share / (2k + 1).

    With S rows and N seats, a row's quota lies within (share of N -+ S/2) -+ 1/2, so only
    that range of quotients is ranked: O(S) rows, however many seats there are.
    """
    every = W.partitionBy(*by)
    rows = rows.withColumn("_all", F.sum(share).over(every)).withColumn("_n", F.count("*").over(every))
    part = F.when(F.col("_all") > 0, F.col(share) / F.col("_all")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor(part * (F.col(seats) - F.col("_n") / 2) - 0.5))
    high = F.ceil(part * (F.col(seats) + F.col("_n") / 2) + 0.5)
    rows = rows.withColumn("_low", low.cast("long")).withColumn("_high", F.greatest(high.cast("long"), F.col("_low")))
    rows = rows.withColumn("_free", F.col(seats) - F.sum("_low").over(every))
    tries = rows.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high")))).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*by).orderBy((F.col(share) / (2 * F.col("_k") + 1)).desc(), order)))
    won = tries.where((F.col("_rank") <= F.col("_free")) & (F.col(share) > 0)).groupBy(*by, order).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*by, order]))
    out = rows.join(won, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_all", "_n", "_low", "_high", "_free", "_won")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42,
    block: int = BLOCK, shard_words: int = SHARD_WORDS, group_shards: int = GROUP_SHARDS,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; sizes are words.

    Null and empty texts have size 0 and are never taken; a text of any length is a size. A null
    source is a source of its own, last. Of equal quotients the source, group or shard of the
    smaller number is served first. Repeated rows count each; rows of one id are ordered by size,
    so reruns agree. An empty table, or one without words, takes nothing. Other columns are
    ignored. The windows over all sources are one task: sources are meant to be tens to
    thousands, not one a host.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"))
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    draw = lambda at: F.conv(F.substring(name, at, 7), 16, 10).cast("long")
    rows = stored(rows.select("*", name.alias("draw"), draw(1).alias("d1"), draw(8).alias("d2")), "sizes")

    targets = source_targets(rows, weights, share, most)
    blocks = F.floor(F.lit(share) * F.sum("source_size").over(W.partitionBy()) / block + 0.5).cast("long")
    sources = apportioned(targets.withColumn("blocks", blocks).withColumn("one", F.lit(1)), "target", "blocks", ["one"], "sid")
    sources = stored(sources.withColumnRenamed("quota", "source_blocks").drop("one", "blocks"), "sources")

    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")
    groups = F.ceil(F.col("shards") / group_shards).cast("long")
    rows = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("shards", shards).withColumn("shard", F.pmod("d1", "shards")).withColumn("grp", F.pmod("shard", groups))
    found = stored(rows.groupBy("sid", "grp", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks")), "shards")
    by_group = found.groupBy("sid", "grp").agg(F.sum("shard_size").alias("group_size"), F.first("source_blocks").alias("source_blocks"))
    by_group = apportioned(by_group, "group_size", "source_blocks", ["sid"], "grp").select("sid", "grp", F.col("quota").alias("group_blocks"))
    by_shard = apportioned(found.join(by_group, ["sid", "grp"]), "shard_size", "group_blocks", ["sid", "grp"], "shard")
    by_shard = by_shard.select("sid", "grp", "shard", "shard_size", "quota")

    rows = rows.join(by_shard, ["sid", "grp", "shard"])
    before = W.partitionBy("sid", "grp", "shard").orderBy("d2", "draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    read = F.least(F.col("quota") * block, most * F.col("shard_size"))
    rounds = F.coalesce(F.floor(read / F.nullif(F.col("shard_size"), F.lit(0))), F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), read - rounds * F.col("shard_size") - F.col("_before")))
    return rows.select("doc_id", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))
