"""Merkle manifest of a dataset: a content-addressed store of tree records, and proofs by descent.

Leaves are ranked within their group (by id), and each group's leaves are hashed two by two
until one digest, the group's subroot, remains; the subroots make the root in the same way.

The tree is kept as a store of records, each under its node's digest. A record holds
``LEVELS`` levels of digests below the node, so that one look-up answers that many binary
digits of a rank. Leaf requests descend from the root: at each look-up the digits of the rank
select a child, the children that are not selected join the path, and at the leaf the path,
gathered from the top, is reversed. Requests that stand at the same node travel as one row,
so the root is looked up once, not once a leaf, and no node is a hot key.

Tables between the steps are written to the shared folder. Ranks come from the places of rows
in range-sorted files: no window over a whole group, no collected list of leaves. What a task
holds of a tree is one record, 2 ** LEVELS digests wide.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scanmart.session import shared_path

from .common import stored

#: Levels of the tree in one record: up to 64 digests wide.
LEVELS = 6
FIELDS = (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))


def encoded(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def tampered_ids(doc_id: Column, one_in: int = 7) -> Column:
    """The ids whose rows the check of the manifest changes."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % one_in == 0, F.lit(False))


def leaf_table(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, changed): ``grp`` is the language with a sign before it, empty for null, so that
    it sorts null first; ``changed`` is the leaf of the row with 1 added to n_chars, where that is to be checked."""
    rows = docs.select(*(F.col(name).cast(kind).alias(name) for name, kind in FIELDS))
    fields = {name: encoded(F.col(name)) for name, _ in FIELDS}
    more = fields | {"n_chars": encoded(F.col("n_chars") + 1)}
    return rows.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("grp"), "doc_id", digest(*fields.values()).alias("leaf"),
        F.when(tampered_ids(F.col("doc_id")), digest(*more.values())).alias("changed"))


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` (with ``grp``) and ``idx``, the 0-based rank within the group by ``keys``, and ``n``, the group's size.

    The rows are written in sorted ranges. A row's rank is its place in its file and the
    sizes of the group's parts in the files before; a group may span any number of files."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    order = [F.asc_nulls_first(k) for k in ("grp", *keys)]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    files = spark.read.schema(rows.schema).parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    least = F.min(F.struct(*(x for k in keys for x in (F.col(k).isNotNull(), F.col(k)))))
    parts = files.groupBy("grp", "_file").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"), least.alias("_least"))
    group = W.partitionBy("grp")  # a row a file
    before = F.sum("_size").over(group.orderBy("_least", "_file").rowsBetween(W.unboundedPreceding, -1))
    parts = stored(parts.select("grp", "_file", "_first", F.coalesce(before, F.lit(0)).alias("_before"),
                                F.sum("_size").over(group).alias("n")), f"{name}-parts")
    return files.join(parts, ["grp", "_file"]).select(*rows.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("idx"), "n")


def depth(n: Column) -> Column:
    """How often ``n`` nodes are halved, rounding up, until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


@dataclass
class Tree:
    """The trees of all groups. ``records[i]`` (digest, levels) covers levels i * LEVELS and up; ``tops``: (grp, digest)."""

    records: list[DataFrame]
    tops: DataFrame


def built(nodes: DataFrame, name: str) -> Tree:
    """The trees over ``nodes`` (grp, idx, n, digest), as many levels a round as a record holds.

    The rounds are the tree's depth divided by LEVELS; only whether nodes are left is known to the driver."""
    records, nodes = [], stored(nodes, f"{name}-nodes")
    tops = nodes.where("n = 1").select("grp", "digest")
    while (nodes := nodes.where("n > 1")).limit(1).count():
        wide = nodes.groupBy("grp", "n", F.shiftright("idx", LEVELS).alias("seg")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest")))["digest"].alias("row0"))  # at most 2 ** LEVELS digests
        for level in range(LEVELS):
            below = F.col(f"row{level}")
            # a run of two; the last may be alone
            wide = wide.withColumn(f"row{level + 1}", F.transform(
                F.sequence(F.lit(0), F.ceil(F.size(below) / 2).cast("int") - 1),
                lambda i: digest(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit("")))))  # noqa: B023
        wide = wide.withColumn("steps", F.least(depth(F.col("n")), F.lit(LEVELS)))
        levels = F.array(*(f"row{i}" for i in range(LEVELS + 1)))
        wide = stored(wide.select(
            "grp", F.col("seg").alias("idx"), F.expr("(n + shiftleft(1L, steps) - 1) div shiftleft(1L, steps)").alias("n"),
            F.get(F.get(levels, F.col("steps")), F.lit(0)).alias("digest"), F.slice(levels, F.lit(1), F.col("steps")).alias("levels")),
            f"{name}-records")
        records.append(wide.select("digest", "levels"))
        nodes = wide.select("grp", "idx", "n", "digest")
        tops = tops.unionByName(nodes.where("n = 1").select("grp", "digest"))
    return Tree(records, tops)


@dataclass
class Manifest:
    """leaves: (grp, doc_id, leaf, changed, idx, n); groups: (grp, n, subroot, place, root), place being the subroot's rank."""

    leaves: DataFrame
    tree: Tree
    top: Tree
    groups: DataFrame

    def children(self) -> DataFrame:
        """The store node by node: (digest, children), one row for each inner node's digest."""
        out = None
        for records in (*self.tree.records, *self.top.records):
            rows = records.select(F.posexplode("levels").alias("level", "below"), F.concat(F.slice(
                "levels", 2, LEVELS), F.array(F.array("digest"))).alias("above"))
            pairs = F.transform(F.get("above", F.col("level")), lambda d, i: F.struct(
                d.alias("digest"), F.slice("below", 2 * i + 1, 2).alias("children")))
            rows = rows.select(F.explode(pairs).alias("x")).select("x.*")
            out = rows if out is None else out.unionByName(rows)
        return out.dropDuplicates(["digest"]) if out is not None else self.leaves.select(
            F.col("leaf").alias("digest"), F.array("leaf").alias("children")).limit(0)


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).

    Any field may be null; texts may be of any length (only their digests move); equal ids are
    ordered by their leaves, and repeated rows are leaves each. An empty table has no root."""
    leaves = ranked(stored(leaf_table(docs), "leaves"), ["doc_id", "leaf"], "ranks")
    tree = built(leaves.select("grp", "idx", "n", F.col("leaf").alias("digest")), "tree")
    sizes = leaves.groupBy("grp").agg(F.max("n").alias("n"))
    subroots = tree.tops.withColumnRenamed("digest", "subroot").join(sizes, "grp")
    one = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("n").alias("leaves"), "subroot")
    places = ranked(stored(one, "subroots"), ["name"], "places")
    top = built(places.select("grp", "idx", "n", F.col("subroot").alias("digest")), "top")
    root = top.tops.select("grp", F.col("digest").alias("root"))
    groups = places.join(root, "grp").select(
        F.col("name").alias("grp"), F.col("leaves").alias("n"), "subroot", F.col("idx").alias("place"), "root",
        F.col("n").alias("n_groups"))
    return Manifest(leaves, tree, top, stored(groups, "groups"))


def _below(records: DataFrame) -> DataFrame:
    """Records as looked up: one for each digest (equal subtrees have equal records)."""
    return records.dropDuplicates(["digest"]).withColumnRenamed("digest", "node")


def _unselected(levels: Column, digit: Column) -> Column:
    """From the top down, the children beside the way that the digits of ``digit`` take through a record."""
    steps = [F.when(F.size(levels) > j, F.struct(
        F.get(F.get(levels, F.lit(j)), F.shiftright(digit, j).bitwiseXOR(F.lit(1))).alias("sibling"),
        (F.shiftright(digit, j).bitwiseAND(F.lit(1)) == 1).alias("left"))) for j in range(LEVELS - 1, -1, -1)]
    return F.array_compact(F.array(*steps))


def _descended(states: DataFrame, records: DataFrame, level: int) -> DataFrame:
    """States (node, pos, height, path and more) one record further down, where they stand above ``level``."""
    kept = [c for c in states.columns if c not in ("node", "pos", "height", "path")]
    there = states.where(F.col("height") > level).join(_below(records), "node")
    there = there.select(*kept, "pos", "path", "levels", F.posexplode(F.get("levels", F.lit(0))).alias("digit", "node"))
    there = there.select(
        *kept, "node", (F.expr("shiftleft(pos, size(levels))") + F.col("digit")).alias("pos"), F.lit(level).alias("height"),
        F.concat("path", _unselected(F.col("levels"), F.col("digit"))).alias("path"))
    return states.where(F.col("height") <= level).select(*there.columns).unionByName(there)


def proofs(of: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(grp, doc_id, leaf, changed, subroot, root, path) for the leaves of the ids in ``requests`` (doc_id), or for all.

    path: from the leaf up, for each level the sibling (null: none) and whether it stands to the left."""
    leaves = of.leaves if requests is None else of.leaves.join(
        requests.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def asked(states: DataFrame, level: int) -> DataFrame:
        if requests is None:
            return states
        wanted = leaves.select("grp", F.shiftright("idx", level).alias("pos")).distinct()
        return states.join(wanted, ["grp", "pos"], "left_semi")

    none = F.array().cast("array<struct<sibling:string,left:boolean>>")
    # the root is one row; its group is that of the groups
    states = of.groups.select("root", "n_groups").distinct().select(
        F.col("root").alias("node"), F.lit(0).cast("long").alias("pos"), depth(F.col("n_groups")).alias("height"), none.alias("path"))
    for i in reversed(range(len(of.top.records))):
        states = _descended(states, of.top.records[i], i * LEVELS)
    states = states.select(F.col("pos").alias("place"), "path").join(of.groups, "place").select(
        "grp", "subroot", "root", F.col("subroot").alias("node"), F.lit(0).cast("long").alias("pos"),
        depth(F.col("n")).alias("height"), "path")
    for i in reversed(range(1, len(of.tree.records))):
        states = asked(_descended(states, of.tree.records[i], i * LEVELS), i * LEVELS)
    if of.tree.records:
        states = states.join(_below(of.tree.records[0]), "node", "left")
    else:
        states = states.withColumn("levels", F.lit(None).cast("array<array<string>>"))
    states = states.select("grp", "subroot", "root", "path", "levels", F.col("pos").alias("seg"))
    found = leaves.withColumn("seg", F.shiftright("idx", LEVELS)).join(states, ["grp", "seg"])
    digit = F.col("idx").bitwiseAND(F.lit((1 << LEVELS) - 1)).cast("int")
    last = F.when(F.col("levels").isNotNull(), _unselected(F.col("levels"), digit)).otherwise(none)
    return found.select("grp", "doc_id", "leaf", "changed", "subroot", "root", F.reverse(F.concat("path", last)).alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.when(step["left"], F.concat(step["sibling"], node)).otherwise(
        F.concat(node, F.coalesce(step["sibling"], F.lit("")))), 256))


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, one after the other."""
    return F.sha2(F.array_join(F.transform(path, lambda step: step["sibling"]), ""), 256)


def checked(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row; see ``manifest``.

    folded_root comes from the changed leaf where the id asks for it, else from the row's own."""
    rows = proofs(manifest(docs)).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
