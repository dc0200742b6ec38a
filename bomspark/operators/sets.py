"""Set operations and merge of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from .graph import connected_components
from .skew import newest_per_key

IDENTITY = "identity"


def with_identity(components: DataFrame) -> DataFrame:
    """Package url, else (type, group, name, version)."""
    fallback = F.concat_ws("|", "type", F.coalesce("comp_group", F.lit("")), "name", F.coalesce("version", F.lit("")))
    return components.withColumn(IDENTITY, F.coalesce("purl", fallback))


def merge_boms(boms: DataFrame, components: DataFrame, by: str) -> DataFrame:
    """All documents of a group as one inventory: each identity once, refs
    prefixed with the document so they stay unique, strictest marking."""
    tlp = boms.groupBy(by).agg(F.max_by("tlp", S.tlp_rank("tlp")).alias("tlp"))
    c = with_identity(components).join(boms.select("bom_id", by), "bom_id")
    ref = F.concat_ws(":", F.col("bom_id").cast("string"), "bom_ref")
    kept = c.groupBy(by, IDENTITY).agg(
        F.min_by(ref, F.struct("bom_id", "bom_ref")).alias("bom_ref"), F.count("*").alias("n_merged")
    )
    return kept.join(tlp, by)


def common_components(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def common_components_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return (
        a.exceptAll(b).withColumn("side", F.lit("first"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
    )


def alias_edges(vulns: DataFrame, keys: list) -> DataFrame:
    """Star edges: each member to the smallest of its group, never all pairs."""
    named = vulns.select("vuln_key", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    cols = [f"_k{i}" for i in range(len(keys))]
    heads = named.groupBy(*cols).agg(F.min("vuln_key").alias("dst"))
    # records without one of the keys form groups too
    same = reduce(lambda a, b: a & b, [named[c].eqNullSafe(heads[c]) for c in cols])
    return named.join(heads, same).select(F.col("vuln_key").alias("src"), "dst")


def alias_groups(vulns: DataFrame, keys: list) -> DataFrame:
    """``vuln_key -> group_key``: one id for records that name the same thing."""
    return connected_components(alias_edges(vulns, keys)).select(
        F.col("node").alias("vuln_key"), F.col("component").alias("group_key")
    )


def reference_edges(vulns: DataFrame, references: DataFrame) -> DataFrame:
    """Edges of the graph record - id, with each id drawn together to the
    smallest record that bears or names it. ``vulns(vuln_key, id)`` and
    ``references(vuln_key, id)``: ids meet in any case and without blanks around
    them. The smallest record of an id is counted before the join, so an id of a
    third of all records costs one row a record."""
    spoken = lambda df: df.select("vuln_key", F.upper(F.trim("id")).alias("_id"))
    bears = spoken(vulns).unionByName(spoken(references.join(vulns.select("vuln_key").distinct(), "vuln_key", "left_semi")))
    bears = bears.filter("_id <> '' AND vuln_key IS NOT NULL").distinct()
    hubs = bears.groupBy("_id").agg(F.min("vuln_key").alias("dst"))
    own = vulns.filter("vuln_key IS NOT NULL").select(F.col("vuln_key").alias("src"), F.col("vuln_key").alias("dst"))
    linked = bears.join(hubs, "_id").filter("vuln_key <> dst").select(F.col("vuln_key").alias("src"), "dst")
    return own.unionByName(linked).distinct()


def reference_groups(vulns: DataFrame, references: DataFrame) -> DataFrame:
    """``vuln_key -> group_key``: records that name each other, or a third id,
    through any number of references, under the smallest key of the group.

    Records without id or references are groups of their own, null keys give no
    row, references of unknown records link nothing, an id that no record
    bears still links those that name it. Repeated rows change nothing."""
    return connected_components(reference_edges(vulns, references)).select(
        F.col("node").alias("vuln_key"), F.col("component").alias("group_key")
    )


def dedupe_vulnerabilities(vulns: DataFrame, groups: DataFrame) -> DataFrame:
    """Newest record of each alias group."""
    return newest_per_key(vulns.join(groups, "vuln_key"), ["group_key"], [F.col("published_at"), F.col("vuln_key")])


def unify_versions(tables: list[DataFrame]) -> DataFrame:
    """Tables of different spec versions as one; missing columns become null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
