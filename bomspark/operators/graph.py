"""Iterative graph operators. Each round is one join plus one aggregate, its
result goes to a reliable checkpoint, and a round works on the frontier only.

Levels are kept as separate checkpointed frames and united at the end, so a
round never rewrites the rows of earlier rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, is_empty


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def transitive_dependencies(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from ``start(node)`` over ``edges(src, dst)`` with the
    smallest depth. Start nodes have depth 0. Stops when nothing new appears."""
    e = cut(edges.select("src", "dst").distinct())
    frontier = cut(start.select("node").distinct())
    levels = [frontier.withColumn("depth", F.lit(0))]
    depth = 0
    while max_depth is None or depth < max_depth:
        seen = _union([lv.select("node") for lv in levels])
        step = (
            e.join(frontier, e.src == frontier.node, "left_semi").select(F.col("dst").alias("node")).distinct()
            .join(seen, "node", "left_anti")
        )
        frontier = cut(step)
        if is_empty(frontier):
            break
        depth += 1
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    return _union(levels)


def reverse_impact(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything that depends on a start node, directly or not."""
    return transitive_dependencies(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_depth)


def graph_roots(edges: DataFrame) -> DataFrame:
    """Nodes nothing depends on."""
    return edges.select(F.col("src").alias("node")).distinct().join(
        edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"
    )


def dependency_depth(edges: DataFrame) -> DataFrame:
    """How many nodes sit at each smallest depth from the roots."""
    return transitive_dependencies(edges, graph_roots(edges)).groupBy("depth").agg(F.count("*").alias("n"))


def trim_acyclic(edges: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle because an end has no way in or no
    way out, until nothing more falls off."""
    e = cut(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        kept = cut(
            e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        )
        m = kept.count()
        if m == n:
            break
        e, n = kept, m
    return e


def _reach_label(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Largest label that reaches each node: every node takes the maximum of
    its own and its predecessors' labels until stable."""
    labels = cut(labels)
    while True:
        incoming = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.max("label").alias("_in")
        )
        step = cut(
            labels.join(incoming, "node", "left").select(
                "node", F.greatest("label", F.coalesce("_in", F.col("label"))).alias("label"),
                (F.coalesce("_in", F.col("label")) > F.col("label")).alias("_changed"),
            )
        )
        changed = step.filter("_changed").limit(1).count()
        labels = step.drop("_changed")
        if not changed:
            return labels


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node -> scc`` for nodes on a cycle. Forward colouring: the largest id
    that reaches a node is its colour; inside a colour, whatever reaches back to
    the colour's own node forms one component. Found components are removed and
    the rest is trimmed and coloured again."""
    self_loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("scc")).distinct()
    found: list[DataFrame] = []
    rest = trim_acyclic(edges.filter("src <> dst"))
    while not is_empty(rest):
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = _reach_label(rest, nodes.withColumn("label", F.col("node")))
        inside = (
            rest.join(colour.select(F.col("node").alias("src"), F.col("label").alias("_a")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("label").alias("_b")), "dst")
            .filter("_a = _b").select("src", "dst", "_a")
        )
        inside = cut(inside)
        # colour ids are node ids, so "reaches its colour" is reachability over reversed edges inside the colour
        heads = colour.filter("node = label").select("node")
        back = transitive_dependencies(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), heads)
        members = cut(back.select("node").join(colour, "node").select("node", F.col("label").alias("scc")))
        sizes = members.groupBy("scc").agg(F.count("*").alias("_n")).filter("_n > 1")
        found.append(cut(members.join(sizes, "scc", "left_semi").select("node", "scc")))
        gone = members.select("node")
        rest = trim_acyclic(
            rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        )
    cyc = _union(found) if found else self_loops.limit(0)
    alone = self_loops.join(cyc.select("node"), "node", "left_anti")
    return cyc.unionByName(alone.select("node", "scc"))


def dependency_cycles(edges: DataFrame) -> DataFrame:
    return strongly_connected(edges).select("node")


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """One shortest path from a start node to each reachable node. A node keeps
    its smallest predecessor of the level before; the path text grows by one
    step per level and is carried by one row per node. The joins of a level are
    merges: a broadcast would take its paths, and all nodes seen, through the driver."""
    e = cut(edges.select("src", "dst").distinct())
    frontier = cut(start.select("node", F.col("node").cast("string").alias("path")).distinct())
    levels = [frontier.withColumn("depth", F.lit(0))]
    while True:
        seen = _union([lv.select("node") for lv in levels])
        step = (
            e.join(frontier.withColumnRenamed("node", "src").hint("merge"), "src")
            .groupBy(F.col("dst").alias("node")).agg(F.min_by("path", "src").alias("path"))
            .join(seen.hint("merge"), "node", "left_anti")
            .select("node", F.concat("path", F.lit(">"), F.col("node").cast("string")).alias("path"))
        )
        frontier = cut(step)
        if is_empty(frontier):
            return _union(levels)
        levels.append(frontier.withColumn("depth", F.lit(len(levels))))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node -> component`` (smallest node id). Smallest label among the
    neighbours, then a jump to the label's own label, until nothing changes."""
    e = edges.select("src", "dst")
    both = cut(e.union(e.select("dst", "src")).toDF("src", "dst").filter("src <> dst").distinct())
    all_nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    labels = cut(all_nodes.withColumn("label", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(
            F.min("label").alias("_near")
        )
        hooked = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", F.col("label"))).alias("label")
        )
        hooked = cut(hooked)
        parent = hooked.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        jumped = cut(
            hooked.join(parent, "label", "left").select(
                "node", "_old", F.least("label", F.coalesce("_up", F.col("label"))).alias("label")
            )
        )
        changed = jumped.filter("_old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def longest_levels(edges: DataFrame) -> DataFrame:
    """Topological level of each node of an acyclic graph: the longest path
    from a root. A round takes the nodes without a way in and the edges that
    leave them; what is left without such a node has a cycle."""
    rest = cut(edges.select("src", "dst").distinct())
    nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
    open_ = cut(nodes.join(rest.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ways")), "node", "left").select("node", F.coalesce("ways", F.lit(0)).alias("ways")))
    levels: list[DataFrame] = []
    while True:
        now = cut(open_.filter("ways = 0").select("node"))
        if is_empty(now):
            break
        levels.append(now.withColumn("level", F.lit(len(levels))))
        fewer = rest.join(now, rest.src == now.node, "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("less"))
        open_ = cut(
            open_.filter("ways > 0").join(fewer, "node", "left").select("node", (F.col("ways") - F.coalesce("less", F.lit(0))).alias("ways"))
        )
    if not is_empty(open_):
        raise ValueError("the graph has a cycle")
    return _union(levels) if levels else open_.select("node", F.lit(0).alias("level"))


def ancestor_chain(parents: DataFrame, key: list[Column] | None = None) -> DataFrame:
    """Tree levels from ``parents(node, parent)`` (null parent = top): depth and
    the chain of ancestors as text, top first."""
    p = cut(parents.select("node", "parent"))
    frontier = cut(
        p.filter("parent IS NULL").select("node", F.col("node").cast("string").alias("chain"))
    )
    levels = [frontier.withColumn("depth", F.lit(0))]
    while True:
        frontier = cut(
            p.join(frontier.select(F.col("node").alias("parent"), "chain"), "parent").select(
                "node", F.concat("chain", F.lit("/"), F.col("node").cast("string")).alias("chain")
            )
        )
        if is_empty(frontier):
            return _union(levels)
        levels.append(frontier.withColumn("depth", F.lit(len(levels))))
