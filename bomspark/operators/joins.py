"""Joins of the model's tables. Sides are aggregated to their distinct keys
before many-to-many joins, so a key that holds a large share of the rows does
not multiply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .skew import newest_per_key, split_lag, split_running_sum


def filter_inventory(
    components: DataFrame, types: list[str] | None = None, scopes: list[str] | None = None,
    external: bool | None = None, group: str | None = None, tag: str | None = None,
) -> DataFrame:
    out = components
    if types:
        out = out.filter(F.col("type").isin(types))
    if scopes:
        out = out.filter(F.coalesce("scope", F.lit("required")).isin(scopes))
    if external is not None:
        out = out.filter(F.coalesce("is_external", F.lit(False)) == external)
    if group is not None:
        out = out.filter(F.col("comp_group") == group)
    if tag is not None:
        out = out.filter(F.array_contains("tags", tag))
    return out


def filter_by_property(owners: DataFrame, properties: DataFrame, name: str, pattern: str | None = None) -> DataFrame:
    """Owners (bom_id, pointer) that carry a property by name and, optionally, a value pattern."""
    hit = properties.filter(F.col("name") == name)
    if pattern is not None:
        hit = hit.filter(F.col("value").like(pattern))
    return owners.join(
        hit.select("bom_id", F.col("owner_pointer").alias("pointer")), ["bom_id", "pointer"], "left_semi"
    )


def resolve_refs(uses: DataFrame, refs: DataFrame) -> DataFrame:
    """``uses(bom_id, field, target)`` -> element type, null where nothing declares the ref."""
    declared = refs.groupBy("bom_id", F.col("ref").alias("target")).agg(F.min("element_type").alias("element_type"))
    return uses.join(declared, ["bom_id", "target"], "left")


def parsed_links(links: DataFrame, column: str = "link") -> DataFrame:
    p = S.bom_link_parts(column)
    return links.withColumn("_p", p).select(
        *links.columns, F.col("_p.uuid").alias("to_uuid"), F.col("_p.version").alias("to_version"),
        F.col("_p.ref").alias("to_ref"),
    )


def resolve_bom_links(links: DataFrame, boms: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Links to documents by (serial, version) and, when ``refs`` is given, to
    an element inside the found document."""
    docs = boms.select(
        S.serial_uuid("serial_number").alias("to_uuid"), F.col("version").alias("to_version"), F.col("bom_id").alias("to_bom")
    )
    found = parsed_links(links).join(docs, ["to_uuid", "to_version"])
    if refs is None:
        return found
    keys = refs.select(F.col("bom_id").alias("to_bom"), F.col("ref").alias("to_ref")).distinct()
    return found.join(keys.withColumn("_hit", F.lit(True)), ["to_bom", "to_ref"], "left").withColumn(
        "resolved", F.col("to_ref").isNull() | F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def unresolved_bom_links(links: DataFrame, boms: DataFrame) -> DataFrame:
    docs = boms.select(S.serial_uuid("serial_number").alias("to_uuid"), F.col("version").alias("to_version")).distinct()
    return parsed_links(links).join(docs, ["to_uuid", "to_version"], "left_anti")


def graph_absent_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes the graph does not mention as a source: their dependencies are
    unknown, which is not the same as none."""
    return nodes.join(edges.select("ref").distinct(), "ref", "left_anti")


def leaf_components(edges: DataFrame) -> DataFrame:
    """Nodes declared in the graph with an explicitly empty dependency list."""
    out = edges.groupBy("bom_id", "ref").agg(F.bool_and("declared_empty").alias("leaf"))
    return out.filter("leaf").drop("leaf")


def boms_containing(boms: DataFrame, components: DataFrame, wanted: DataFrame, on: str = "purl") -> DataFrame:
    hits = components.select("bom_id", on).join(wanted.select(on).distinct(), on, "left_semi").select("bom_id")
    return boms.join(hits, "bom_id", "left_semi")


def affected_components(affects: DataFrame, components: DataFrame) -> DataFrame:
    """``affects(bom_id, vuln_id, ref)`` -> component fields by (bom_id, ref)."""
    c = components.withColumnRenamed("bom_ref", "ref")
    return affects.join(c, ["bom_id", "ref"], "left")


def package_versions(components: DataFrame) -> DataFrame:
    return components.groupBy("package_id", "version").agg(F.count("*").alias("n_components"))


def with_version_key(df: DataFrame, out: str = "_k") -> DataFrame:
    """``df`` holds each version of a package once, so its key is a projection;
    a join with the distinct texts would read the input again."""
    return df.withColumn(out, S.version_key("version"))


def with_compiled_range(df: DataFrame, out: str = "_r") -> DataFrame:
    """As :func:`with_version_key`, for ranges."""
    return df.withColumn(out, S.range_compiled("vers_range"))


def match_vulnerabilities(components: DataFrame, vulns: DataFrame) -> DataFrame:
    """Package versions against version ranges. Both sides shrink to distinct
    (package, version) and (package, range) with counts before they meet."""
    pv = with_version_key(package_versions(components))
    rng = with_compiled_range(
        vulns.groupBy("package_id", "vers_range").agg(F.count("*").alias("n_vulns"), F.max("score").alias("max_score"))
    )
    return (
        pv.join(rng, "package_id").filter(S.key_in_compiled(F.col("_k"), F.col("_r")))
        .select("package_id", "version", "vers_range", "n_components", "n_vulns", "max_score")
    )


def vulnerability_status(components: DataFrame, affects: DataFrame) -> DataFrame:
    """Status per package version from ``affects(package_id, version, vers_range,
    status)``. No status means affected; an explicit version beats a range;
    among equals the stronger statement (affected, unknown, unaffected) wins."""
    a = affects.withColumn("status", F.coalesce("status", F.lit("affected")))
    pv = package_versions(components)
    strength = F.when(F.col("status") == "affected", 2).when(F.col("status") == "unknown", 1).otherwise(0)
    exact = pv.join(a.filter("version IS NOT NULL").select("package_id", "version", "status").distinct(), ["package_id", "version"])
    ranges = a.filter("vers_range IS NOT NULL").select("package_id", "vers_range", "status").distinct()
    ranged = (
        with_version_key(pv).join(with_compiled_range(ranges), "package_id")
        .withColumn("_in", S.key_in_compiled(F.col("_k"), F.col("_r")))
        .filter(F.col("_in") | F.col("_in").isNull())
        .select("package_id", "version", F.when(F.col("_in"), F.col("status")).otherwise("unknown").alias("status"))
    )
    every = exact.select("package_id", "version", "status", F.lit(1).alias("_s")).unionByName(
        ranged.withColumn("_s", F.lit(0))
    )
    return every.groupBy("package_id", "version").agg(
        F.max_by("status", F.struct("_s", strength)).alias("status")
    )


def apply_vex(inventory: DataFrame, analyses: DataFrame) -> DataFrame:
    """Newest analysis per (package, source) laid over an inventory."""
    newest = newest_per_key(
        analyses.select("package_id", "source_name", "analysis_state", "published_at", "vuln_key"),
        ["package_id", "source_name"], [F.col("published_at"), F.col("vuln_key")],
    )
    return inventory.join(newest.select("package_id", "source_name", "analysis_state"), "package_id", "left")


def observed_vs_concluded(declared: DataFrame, observed: DataFrame) -> DataFrame:
    j = declared.join(observed, "package_id", "full_outer")
    verdict = (
        F.when(F.col("declared").isNull(), "observed_only").when(F.col("observed").isNull(), "declared_only")
        .when(F.col("declared") == F.col("observed"), "agree").otherwise("conflict")
    )
    return j.withColumn("verdict", verdict)


def license_policy(license_uses: DataFrame, policy: dict[str, str], default: str = "review") -> DataFrame:
    """Decision per license from a user policy. A dict is driver data already,
    so its size is known; it becomes a literal map."""
    pairs = [F.lit(x) for kv in policy.items() for x in kv]
    return license_uses.withColumn(
        "decision", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("license_id")), F.lit(default))
    )


def identity_by_hash(hashes: DataFrame) -> DataFrame:
    """Artifacts that occur in more than one document. One row per digest
    instead of all document pairs."""
    per_doc = hashes.groupBy("alg", "value", "bom_id").agg(F.count("*").alias("_n"))
    return per_doc.groupBy("alg", "value").agg(
        F.count("*").alias("n_boms"), F.sum("_n").alias("n_components"), F.min("bom_id").alias("first_bom"),
        F.max("bom_id").alias("last_bom"),
    ).filter("n_boms > 1")


def bom_as_of(boms: DataFrame, at: Column) -> DataFrame:
    """Document version in effect at one moment, per serial number."""
    return newest_per_key(
        boms.filter(F.col("created_at") <= at), ["serial_number"], [F.col("created_at"), F.col("version")]
    )


def bom_as_of_each(points: DataFrame, boms: DataFrame, bucket: str = "month") -> DataFrame:
    """For each (serial_number, at) the version in effect then. Union of both
    sides, last document seen so far; long serials are split by time bucket."""
    b = boms.select(
        "serial_number", F.col("created_at").alias("at"), F.col("version").alias("_v"), F.lit(0).alias("_point"),
        F.lit(None).cast("bigint").alias("point_id"),
    )
    p = points.select(
        "serial_number", "at", F.lit(None).cast("int").alias("_v"), F.lit(1).alias("_point"), "point_id"
    )
    u = b.unionByName(p).withColumn("_b", F.date_trunc(bucket, "at"))
    order = ["at", "_point", "_v", "point_id"]
    inner = Window.partitionBy("serial_number", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = u.withColumn("_seen", F.last("_v", ignorenulls=True).over(inner))
    buckets = u.select("serial_number", "_b").distinct()
    tails = buckets.join(
        u.filter("_v IS NOT NULL").groupBy("serial_number", "_b").agg(F.max_by("_v", F.struct("at", "_v")).alias("_tail")),
        ["serial_number", "_b"], "left",
    )
    outer = Window.partitionBy("serial_number").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("serial_number", "_b", F.last("_tail", ignorenulls=True).over(outer).alias("_carry"))
    return (
        seen.filter("_point = 1").join(carry, ["serial_number", "_b"], "left")
        .select("point_id", "serial_number", "at", F.coalesce("_seen", "_carry").alias("version"))
    )


def _covers(start: str, end: str, lo: Column, hi: Column) -> Column:
    """Interval and [lo, hi] overlap; a null bound is open."""
    return (F.col(start).isNull() | (F.col(start) <= hi)) & (F.col(end).isNull() | (F.col(end) >= lo))


def valid_at(intervals: DataFrame, start: str, end: str, at: Column) -> DataFrame:
    return intervals.filter(_covers(start, end, at, at))


def valid_during(intervals: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Intervals that overlap [lo, hi]."""
    return intervals.filter(_covers(start, end, lo, hi))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, start: str, end: str, at: str = "at") -> DataFrame:
    """Points inside intervals of the same key. An interval is repeated per
    month it touches, one of over a year per year, one of over twelve years or
    with an open end stands once; points ask at each of these scales, then the
    exact condition decides."""
    days = F.datediff(F.col(end).cast("date"), F.col(start).cast("date"))
    always = F.lit("1970-01-01").cast("date")
    scale = F.when(days.isNull() | (days > 4383), 2).when(days > 366, 1).otherwise(0)
    steps = F.when(scale == 0, F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))).when(
        scale == 1, F.sequence(F.trunc(start, "year"), F.trunc(end, "year"), F.expr("INTERVAL 1 YEAR"))
    ).otherwise(F.array(always))
    usable = days.isNull() | (days >= 0)  # an interval that ends before it starts holds nothing
    iv = intervals.filter(usable).withColumn("_s", scale).withColumn("_m", F.explode(steps))
    asks = F.array(*[F.struct(F.lit(i).alias("s"), m.alias("m")) for i, m in enumerate((F.trunc(at, "month"), F.trunc(at, "year"), always))])
    pt = points.withColumn("_q", F.explode(asks)).withColumn("_s", F.col("_q.s")).withColumn("_m", F.col("_q.m")).drop("_q")
    return pt.join(iv, [key, "_s", "_m"]).filter(_covers(start, end, F.col(at), F.col(at))).drop("_s", "_m")


def task_overlap(tasks: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """For each task the number of other tasks of the group that ran at some
    common moment (closed intervals). Starts and ends are counted per moment
    and summed up in order; no pairs are formed.

    overlapping = starts up to my end - ends before my start - 1"""
    ev = tasks.select(group, F.col(start).alias("_t"), F.lit(1).alias("_s"), F.lit(0).alias("_e")).unionByName(
        tasks.select(group, F.col(end).alias("_t"), F.lit(0).alias("_s"), F.lit(1).alias("_e"))
    )
    per_t = ev.groupBy(group, "_t").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    month = F.date_trunc("month", "_t")  # a long group is summed up month by month
    run = split_running_sum(per_t, [group], ["_t"], month, F.col("_s"), "_starts")
    run = split_running_sum(run, [group], ["_t"], month, F.col("_e"), "_ends").withColumn("_ends_before", F.col("_ends") - F.col("_e"))
    a = run.select(group, F.col("_t").alias(end), "_starts")
    b = run.select(group, F.col("_t").alias(start), "_ends_before")
    return (
        tasks.join(a, [group, end]).join(b, [group, start])
        .withColumn("n_overlapping", (F.col("_starts") - F.col("_ends_before") - 1).cast("bigint"))
        .drop("_starts", "_ends_before")
    )


def bom_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and ``new`` hold (keys..., version). Added, removed and changed
    keys; several versions of one key in a document compare as a set."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias(name))

    j = side(old, "old_version").join(side(new, "new_version"), keys, "full_outer")
    change = (
        F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed")
        .when(F.col("old_version") != F.col("new_version"), "changed")
    )
    return j.withColumn("change", change).filter(F.col("change").isNotNull())


def claims_for_requirement(requirements: DataFrame, maps: DataFrame, assessors: DataFrame) -> DataFrame:
    """Requirement -> attestation map -> assessor, with claims and counter claims counted."""
    per = maps.groupBy("requirement_id", "assessor_id").agg(
        F.count_if(~F.col("counter_claim")).alias("n_claims"), F.count_if("counter_claim").alias("n_counter_claims")
    )
    return requirements.join(per, "requirement_id").join(assessors, "assessor_id")


def uncovered_requirements(requirements: DataFrame, maps: DataFrame, min_conformance: float) -> DataFrame:
    good = maps.filter(~F.col("counter_claim") & (F.col("conformance_score") >= min_conformance))
    return requirements.join(good.select("requirement_id").distinct(), "requirement_id", "left_anti")


def supplier_geography(components: DataFrame, organizations: DataFrame) -> DataFrame:
    per = components.groupBy("supplier_id").agg(F.count("*").alias("_n"))
    return per.join(organizations, "supplier_id").groupBy("region", "country").agg(
        F.count("*").alias("n_suppliers"), F.sum("_n").alias("n_components")
    )


def previous_documents(boms: DataFrame) -> DataFrame:
    """Each document with the id of the one before it under the same serial."""
    return split_lag(boms, ["serial_number"], ["version"], F.floor(F.col("version") / 64), {"previous_bom": "bom_id"})


def crypto_uses(relations: DataFrame, assets: DataFrame) -> DataFrame:
    """``relations(bom_id, from_ref, relation, target)`` with the asset type of both ends."""
    a = assets.select("bom_id", "ref", "asset_type")
    return (
        relations.join(a.select("bom_id", F.col("ref").alias("from_ref"), F.col("asset_type").alias("from_type")), ["bom_id", "from_ref"], "left")
        .join(a.select("bom_id", F.col("ref").alias("target"), F.col("asset_type").alias("target_type")), ["bom_id", "target"], "left")
    )


def implementers_of(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Who provides a standard or algorithm (``provides`` edges)."""
    c = components.select("bom_id", F.col("bom_ref").alias("ref"), F.col("name").alias("implementer"))
    return edges.filter("kind = 'provides'").join(c, ["bom_id", "ref"], "left").select(
        "bom_id", F.col("target").alias("provided"), "ref", "implementer"
    )


def patent_coverage(assertions: DataFrame, patents: DataFrame, members: DataFrame) -> DataFrame:
    """Assertion -> patent, directly or through the members of a family."""
    direct = assertions.join(
        patents.select("bom_id", F.col("ref").alias("target"), "patent_number", "jurisdiction"), ["bom_id", "target"]
    ).withColumn("via_family", F.lit(None).cast("string"))
    by_family = (
        assertions.join(members.select("bom_id", F.col("family_ref").alias("target"), "member"), ["bom_id", "target"])
        .join(patents.select("bom_id", F.col("ref").alias("member"), "patent_number", "jurisdiction"), ["bom_id", "member"])
        .withColumn("via_family", F.col("target")).drop("member")
    )
    return direct.unionByName(by_family)


def cited_fields(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Citation pointers -> value at the pointer, from a flattened pointer table."""
    return citations.filter("target_kind = 'pointer'").join(
        nodes.select("bom_id", F.col("pointer").alias("target"), F.col("value").alias("cited_value")), ["bom_id", "target"], "left"
    )


def evidence_tools(identities: DataFrame, components: DataFrame) -> DataFrame:
    tools = identities.select("bom_id", "owner_pointer", "field", F.explode("tools").alias("tool_ref"))
    return tools.join(
        components.select("bom_id", F.col("bom_ref").alias("tool_ref"), F.col("name").alias("tool_name")),
        ["bom_id", "tool_ref"], "left",
    )


def annotations_for(annotations: DataFrame, refs: DataFrame) -> DataFrame:
    return annotations.join(
        refs.select("bom_id", F.col("ref").alias("subject"), "element_type"), ["bom_id", "subject"], "left"
    )


def flow_across_trust(flows: DataFrame, services: DataFrame) -> DataFrame:
    """Flows whose known ends lie in different trust zones, or that touch a
    service flagged as crossing its boundary."""
    z = services.select("bom_id", "bom_ref", "trust_zone", "x_trust_boundary")
    src = z.select("bom_id", F.col("bom_ref").alias("source"), F.col("trust_zone").alias("source_zone"), F.col("x_trust_boundary").alias("_sx"))
    dst = z.select("bom_id", F.col("bom_ref").alias("destination"), F.col("trust_zone").alias("destination_zone"), F.col("x_trust_boundary").alias("_dx"))
    j = flows.join(src, ["bom_id", "source"], "left").join(dst, ["bom_id", "destination"], "left")
    crossing = F.coalesce(F.col("source_zone") != F.col("destination_zone"), F.lit(False))
    flagged = F.coalesce("_sx", F.lit(False)) | F.coalesce("_dx", F.lit(False))
    return j.filter(crossing | flagged).drop("_sx", "_dx")
