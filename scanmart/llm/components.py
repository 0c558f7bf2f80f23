"""Connected components of an edge table by alternating stars, all state in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the least neighbour of each node and how many it has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        hot_join(both, stored(_least(both), "least"), "u", "n", 2 * total).where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    edges = stored(edges, "large")
    least = stored(_least(edges), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    moved = hot_join(edges, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v long, u > v); label: the smallest node it reaches.

    Rounds are logarithmic in the number of nodes; each is a few joins on the edge table,
    stored in the shared folder, and only counts and a checksum reach the driver. The
    neighbours of a node with very many are not brought to one task (:func:`hot_join`). Empty
    edges give an empty result.
    """
    edges, seen = stored(edges.select("u", "v").distinct(), "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        edges = stored(_small_star(_large_star(edges, mark[0])), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
