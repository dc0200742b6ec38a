"""Merkle manifest of a table: a digest per row, a tree per group of rows and a
tree over the groups, with a proof for every row.

A node is a row (tree, idx, size of its level, digest). Every level equijoins
its nodes with the computed indices of their siblings (``idx ^ 1`` for binary
trees, slot offsets otherwise), and the rows of slot zero emit the parents. On
the way down each node puts its siblings before its parent's path, so a row ends
with all siblings up to the root. A level has ``fanout`` times fewer rows than
the one below it, and no node meets more than its siblings and its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

FANOUT = 2
#: What ends the siblings of one level of a path, and what stands for the node itself among them.
_STEP, _SELF = "/", "."


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the strings one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 bytes, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def document_leaf(n_chars: Column | None = None) -> Column:
    """Digest of a row of documents; ``n_chars`` replaces that column."""
    n_chars = F.col("n_chars") if n_chars is None else n_chars
    return digest(*[encoded(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, label: str) -> DataFrame:
    """``rows`` with ``idx`` (from 0, in ``order`` within ``tree``) and ``size``
    (rows of the tree), without ``order``'s rows of one tree in one task: rows
    are range-partitioned, counted by (tree, partition), and the counts of the
    partitions before are added."""
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = scratch.put(placed.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), f"{label}-placed")
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("pos").alias("low"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size")
    )
    runs = scratch.put(runs, f"{label}-runs")
    return placed.join(runs, ["tree", "part"]).withColumn("idx", F.col("pos") - F.col("low") + F.col("before")).drop("part", "pos", "low", "before")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with the digests of their siblings of smaller slots (``left``)
    and of larger ones (``right``), concatenated in order of the slots."""
    slot = F.pmod("idx", F.lit(fanout))
    out, left, right = nodes, [F.lit("")], [F.lit("")]
    for k in range(1, fanout):
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else F.col("idx") - slot + F.pmod(slot + k, F.lit(fanout))
        sibling = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_at"), F.col("digest").alias(f"_digest{k}"))
        out = out.withColumn("_sibling", at).join(sibling, (F.col("tree") == F.col("_tree")) & (F.col("_sibling") == F.col("_at")), "left")
        out = out.drop("_sibling", "_tree", "_at")
        found = F.coalesce(F.col(f"_digest{k}"), F.lit(""))
        right.append(F.when(slot + k < fanout, found).otherwise(""))
        left.append(F.when(slot + k >= fanout, found).otherwise(""))
    out = out.withColumns({"left": F.concat(*left), "right": F.concat(*right)})
    return out.drop(*[f"_digest{k}" for k in range(1, fanout)])


def grown(leaves: DataFrame, fanout: int, scratch: Scratch, label: str) -> list[DataFrame]:
    """The levels of all trees from the leaves up, each a written table. A tree
    ends on the level where it has one node."""
    levels = []
    nodes, most = leaves, None
    while True:
        levels.append(scratch.put(with_siblings(nodes, fanout), f"{label}-{len(levels)}"))
        if most is None:
            most = levels[0].agg(F.max("size")).first()[0] or 1
        if most <= 1:
            return levels
        most = -(-most // fanout)
        up = lambda c: F.floor((F.col(c) + (fanout - 1 if c == "size" else 0)) / fanout).cast("long")
        heads = levels[-1].where((F.col("size") > 1) & (F.pmod("idx", F.lit(fanout)) == 0))
        nodes = heads.select("tree", up("idx").alias("idx"), up("size").alias("size"), digest(F.col("left"), F.col("digest"), F.col("right")).alias("digest"))


def proven(levels: list[DataFrame], above: DataFrame | None, fanout: int, scratch: Scratch, label: str) -> DataFrame:
    """The leaves with ``path`` (siblings of each level up to the root) and
    ``subroot`` (digest of their own tree). ``above`` has (tree, path) of the
    trees' own roots in a tree over them."""
    paths = None
    for k in reversed(range(len(levels))):
        here = levels[k]
        ends = here.where("size = 1")
        ends = ends.withColumn("path", F.lit("")) if above is None else ends.join(above.select("tree", "path"), "tree")
        now = ends.withColumn("subroot", F.col("digest"))
        if paths is not None:
            up = paths.select(F.col("tree").alias("_tree"), F.col("idx").alias("_at"), F.col("path").alias("_path"), F.col("subroot"))
            inner = here.where("size > 1").withColumn("_up", F.floor(F.col("idx") / fanout).cast("long"))
            inner = inner.join(up, (F.col("tree") == F.col("_tree")) & (F.col("_up") == F.col("_at")))
            inner = inner.withColumn("path", F.concat("left", F.lit(_SELF), "right", F.lit(_STEP), "_path"))
            now = inner.select(*now.columns).union(now)
        if k:
            paths = scratch.put(now.select("tree", "idx", "path", "subroot"), f"{label}-path-{k}")
    return now


def folded(leaf: Column, path: Column) -> Column:
    """Root that ``leaf`` and the siblings of ``path`` lead to."""
    steps = F.filter(F.split(path, _STEP), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.replace(s, F.lit(_SELF), acc), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.translate(path, _STEP + _SELF, "")


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves of one lang are a tree in order of doc_id (null first; rows that
    repeat a doc_id in order of their leaves, so equal rows are interchangeable);
    the trees' roots, by lang (null first, bytewise), are the leaves of the last
    tree. The last run of a level may have fewer nodes than ``fanout``. A single
    leaf is its tree's root; a single lang's root is the root. Null and
    empty values have different leaves. Texts are hashed where they are read,
    whole, and not moved. Empty tables give no rows; other columns are ignored.

    ``tampered`` is a condition on the rows whose n_chars counts as one more
    when the root is recomputed (not where n_chars is null)."""
    scratch = Scratch(docs.sparkSession, "merkle")
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered & F.col("n_chars").isNotNull(), document_leaf(F.col("n_chars") + 1))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = docs.select(F.col("doc_id"), tree.alias("tree"), document_leaf().alias("digest"), changed.alias("changed"))
    levels = grown(numbered(leaves, ["doc_id", "digest"], scratch, "leaf"), fanout, scratch, "level")

    tops = levels[0].where("size = 1").select("tree", "digest")
    for level in levels[1:]:
        tops = tops.union(level.where("size = 1").select("tree", "digest"))
    tops = tops.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    high = grown(numbered(tops, ["name"], scratch, "top"), fanout, scratch, "top-level")
    root = high[-1].where("size = 1").select("digest").first()
    above = proven(high, None, fanout, scratch, "top").select(F.col("name").alias("tree"), "path")
    above = scratch.put(above, "above")

    rows = proven(levels, above, fanout, scratch, "leaf")
    root = F.lit(root[0] if root else None).cast("string")
    out = rows.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"),
    )
    scratch.drop("leaf-placed", "top-placed", *[f"level-{k}" for k in range(1, len(levels))])
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
