"""Queries for the graph operators, over the whole package graph."""

from pyspark.sql import functions as F

from ..operators import graph as G, sets
from .registry import query


def edges(t):
    return t.dependency_edge.select(F.col("ref").alias("src"), F.col("depends_on").alias("dst"))


def forest(t):
    return t.forward_edge.select(F.col("ref").alias("src"), F.col("depends_on").alias("dst"))


REACH = """roots AS (SELECT DISTINCT ref AS node FROM dependency_edge WHERE ref NOT IN (SELECT depends_on FROM dependency_edge)),
lv AS (SELECT node, 0 AS depth FROM roots UNION SELECT e.depends_on, lv.depth + 1 FROM lv JOIN dependency_edge e ON e.ref = lv.node WHERE lv.depth < 60),
r AS (SELECT node, min(depth) AS depth FROM lv GROUP BY 1)"""


@query("transitive_dependencies", REACH + " SELECT node, CAST(depth AS INT) AS depth FROM r", "dependency_edge")
def _(t):
    e = edges(t)
    return G.transitive_dependencies(e, G.graph_roots(e))


@query(
    "reverse_impact",
    """lv AS (SELECT DISTINCT package_id AS node, 0 AS depth FROM vulnerability WHERE severity = 'critical'
UNION SELECT e.ref, lv.depth + 1 FROM lv JOIN dependency_edge e ON e.depends_on = lv.node WHERE lv.depth < 60)
SELECT node, CAST(min(depth) AS INT) AS depth FROM lv GROUP BY 1""",
    "dependency_edge vulnerability",
)
def _(t):
    start = t.vulnerability.filter("severity = 'critical'").select(F.col("package_id").alias("node"))
    return G.reverse_impact(edges(t), start)


@query(
    "dependency_cycles",
    """clo AS (SELECT ref AS a, depends_on AS b FROM dependency_edge UNION SELECT clo.a, e.depends_on FROM clo JOIN dependency_edge e ON e.ref = clo.b)
SELECT DISTINCT a AS node FROM clo WHERE a = b""",
    "dependency_edge",
)
def _(t):
    return G.dependency_cycles(edges(t))


@query("dependency_depth", REACH + " SELECT CAST(depth AS INT) AS depth, count(*) AS n FROM r GROUP BY 1", "dependency_edge")
def _(t):
    return G.dependency_depth(edges(t))


@query(
    "graph_roots",
    "SELECT DISTINCT ref AS node FROM dependency_edge WHERE ref NOT IN (SELECT depends_on FROM dependency_edge)",
    "dependency_edge",
)
def _(t):
    return G.graph_roots(edges(t))


@query(
    "vulnerable_paths",
    """f AS (SELECT ref, depends_on FROM dependency_edge WHERE depends_on > ref),
lv AS (SELECT DISTINCT ref AS node, CAST(ref AS VARCHAR) AS path, 0 AS depth FROM f WHERE ref NOT IN (SELECT depends_on FROM dependency_edge)
UNION ALL SELECT f.depends_on, concat(lv.path, '>', CAST(f.depends_on AS VARCHAR)), lv.depth + 1 FROM lv JOIN f ON f.ref = lv.node)
SELECT node, path, CAST(depth AS INT) AS depth FROM lv WHERE node IN (SELECT package_id FROM vulnerability WHERE severity = 'critical')""",
    "dependency_edge vulnerability",
)
def _(t):
    # back edges lead to nearer nodes, so they are on no shortest path from a root
    e = edges(t)
    hit = t.vulnerability.filter("severity = 'critical'").select(F.col("package_id").alias("node")).distinct()
    return G.shortest_paths(e, G.graph_roots(e)).join(hit.hint("merge"), "node", "left_semi")


DAY = "CAST(published_at AS DATE)"


@query(
    "alias_groups",
    f"SELECT vuln_key, min(vuln_key) OVER (PARTITION BY package_id, source_name, {DAY}) AS group_key FROM vulnerability",
    "vulnerability",
)
def _(t):
    return sets.alias_groups(t.vulnerability, alias_keys())


_BLOCK = "(p_partkey // 5)"


@query(
    "alias_groups_by_reference",
    f"""SELECT CAST(p_partkey AS BIGINT) AS vuln_key, CAST(CASE WHEN {_BLOCK} % 4 < 2 THEN {_BLOCK} // 4 * 20 ELSE {_BLOCK} * 5 END AS BIGINT) AS group_key
FROM part""",
)
def _(t):
    # a record a part; five in a row name the next one each, two such chains of twenty share an id that no record bears
    k = F.col("p_partkey").cast("bigint")
    block = F.expr("p_partkey div 5")
    parts = t.raw("part")
    vulns = parts.select(k.alias("vuln_key"), F.concat(F.lit("V-"), k.cast("string")).alias("id"))
    following = F.when(k % 5 < 4, F.concat(F.lit(" v-"), (k + 1).cast("string")))
    shared = F.when((k % 5 == 2) & (block % 4 < 2), F.concat(F.lit("G-"), F.expr("p_partkey div 20").cast("string")))
    references = parts.select(k.alias("vuln_key"), F.explode(F.array_compact(F.array(following, shared))).alias("id"))
    return sets.reference_groups(vulns, references).select("vuln_key", "group_key")


def alias_keys():
    return [F.col("package_id"), F.col("source_name"), F.to_date("published_at")]


@query(
    "dedupe_vulnerabilities",
    f"""g AS (SELECT *, min(vuln_key) OVER (PARTITION BY package_id, source_name, {DAY}) AS group_key FROM vulnerability)
SELECT group_key, vuln_key, id, score FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY published_at DESC, vuln_key DESC) AS rn FROM g) x WHERE rn = 1""",
    "vulnerability",
)
def _(t):
    groups = sets.alias_groups(t.vulnerability, alias_keys())
    return sets.dedupe_vulnerabilities(t.vulnerability, groups).select("group_key", "vuln_key", "id", "score")


@query(
    "requirement_tree",
    """p AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN CAST(floor((p_partkey - 1) / 2) AS BIGINT) END AS parent FROM part),
lv AS (SELECT node, CAST(node AS VARCHAR) AS chain, 0 AS depth FROM p WHERE parent IS NULL
UNION ALL SELECT p.node, concat(lv.chain, '/', CAST(p.node AS VARCHAR)), lv.depth + 1 FROM lv JOIN p ON p.parent = lv.node)
SELECT node, chain, CAST(depth AS INT) AS depth FROM lv""",
)
def _(t):
    node = F.col("package_id")
    parents = t.package.select(
        node.alias("node"), F.when(node > 0, F.floor((node - 1) / 2).cast("bigint")).alias("parent")
    )
    return G.ancestor_chain(parents)


@query(
    "task_order",
    """f AS (SELECT ref, depends_on FROM dependency_edge WHERE depends_on > ref),
lv AS (SELECT DISTINCT ref AS node, 0 AS level FROM f WHERE ref NOT IN (SELECT depends_on FROM f)
UNION SELECT f.depends_on, lv.level + 1 FROM lv JOIN f ON f.ref = lv.node)
SELECT node, CAST(max(level) AS INT) AS level FROM lv GROUP BY 1""",
    "dependency_edge",
)
def _(t):
    return G.longest_levels(forest(t))
