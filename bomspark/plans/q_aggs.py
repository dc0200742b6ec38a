"""Queries for aggregations and set operations."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggs as A, joins as J, sets
from .registry import query

CLOSED = "('resolved', 'resolved_with_pedigree', 'false_positive', 'not_affected')"


@query(
    "inventory_counts",
    """SELECT type, scope, spec_version, count(*) AS n, CAST(grouping(type) * 4 + grouping(scope) * 2 + grouping(spec_version) AS BIGINT) AS level
FROM (SELECT c.type, coalesce(c.scope, 'required') AS scope, b.spec_version FROM component c JOIN bom b ON b.bom_id = c.bom_id) x GROUP BY CUBE (type, scope, spec_version)""",
    "bom component",
)
def _(t):
    c = t.component.select("bom_id", "type", F.coalesce("scope", F.lit("required")).alias("scope"))
    return A.inventory_counts(c.join(t.bom.select("bom_id", "spec_version"), "bom_id"), ["type", "scope", "spec_version"])


@query(
    "distinct_packages",
    "SELECT type, count(DISTINCT purl) AS n_packages, count(*) AS n_components FROM component GROUP BY 1",
    "component",
)
def _(t):
    return A.distinct_packages(t.component, "type")


@query(
    "version_spread",
    """SELECT split_part(purl, '@', 1) AS package, count(DISTINCT version) AS n_versions, string_agg(DISTINCT version, ',' ORDER BY version) AS versions
FROM component GROUP BY 1""",
    "component",
)
def _(t):
    c = t.component.select(S.purl_without_version("purl").alias("package"), "version")
    return A.version_spread(c).withColumn("versions", F.array_join("versions", ","))


@query(
    "license_distribution",
    "SELECT license_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM component GROUP BY 1",
    "component",
)
def _(t):
    return A.license_distribution(t.component)


@query(
    "license_families",
    """SELECT license_id, type, count(*) AS n, CAST(grouping(license_id) * 2 + grouping(type) AS BIGINT) AS level FROM component
GROUP BY GROUPING SETS ((license_id), (type), (license_id, type))""",
    "component",
)
def _(t):
    return A.license_families(t.component)


@query(
    "severity_summary",
    "SELECT source_name, analysis_state, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in "critical high medium low info none unknown".split())
    + " FROM vulnerability GROUP BY 1, 2",
    "vulnerability",
)
def _(t):
    return A.severity_summary(t.vulnerability)


@query(
    "rating_consensus",
    """SELECT package_id, max(score) AS max_score, round(CAST(sum(CAST(score AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 10) AS mean_score, round(max(score) - min(score), 6) AS spread, count(*) AS n_ratings,
count(DISTINCT source_name) AS n_sources FROM vulnerability GROUP BY 1""",
    "vulnerability",
)
def _(t):
    return A.rating_consensus(t.vulnerability, "package_id")


@query(
    "open_exposure",
    f"""SELECT c.bom_id, count(*) FILTER (v.analysis_state NOT IN {CLOSED}) AS n_open, count(*) AS n_reported
FROM (SELECT DISTINCT bom_id, package_id FROM component) c JOIN vulnerability v ON v.package_id = c.package_id GROUP BY 1""",
    "component vulnerability",
)
def _(t):
    return A.open_exposure(t.component, t.vulnerability)


@query(
    "quantum_readiness",
    """SELECT state, nist_quantum_level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 6) AS share FROM certificate GROUP BY 1, 2""",
    "certificate",
)
def _(t):
    return A.quantum_readiness(t.certificate, "state")


@query(
    "energy_totals",
    """SELECT model_id, activity, round(sum(kwh), 3) AS kwh, round(sum(co2_cost_t), 3) AS co2_cost_t, round(sum(co2_offset_t), 3) AS co2_offset_t,
round(sum(co2_cost_t - co2_offset_t), 3) AS co2_net_t, CAST(grouping(model_id) * 2 + grouping(activity) AS BIGINT) AS level FROM energy GROUP BY ROLLUP (model_id, activity)""",
    "energy",
)
def _(t):
    return A.energy_totals(t.energy)


@query(
    "conformance_by_standard",
    """SELECT p_brand AS level, requirement_id, round(CAST(sum(CAST(conformance_score AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 10) AS mean_conformance, round(min(conformance_score), 6) AS min_conformance,
round(CAST(sum(CAST(confidence_score AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 10) AS mean_confidence, count(*) FILTER (counter_claim) AS n_counter_claims,
CAST(grouping(p_brand) * 2 + grouping(requirement_id) AS BIGINT) AS grouping
FROM attestation_map JOIN part ON p_partkey = requirement_id GROUP BY ROLLUP (p_brand, requirement_id)""",
    "attestation_map",
)
def _(t):
    req = t.package.select(F.col("package_id").alias("requirement_id"), F.col("brand").alias("level"))
    return A.conformance_by_standard(t.attestation_map, req)


@query(
    "tlp_merge",
    """SELECT serial_number, CASE max(CASE tlp WHEN 'CLEAR' THEN 0 WHEN 'GREEN' THEN 1 WHEN 'AMBER' THEN 2 WHEN 'AMBER_AND_STRICT' THEN 3 ELSE 4 END)
WHEN 0 THEN 'CLEAR' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'AMBER' WHEN 3 THEN 'AMBER_AND_STRICT' ELSE 'RED' END AS tlp FROM bom GROUP BY 1""",
    "bom",
)
def _(t):
    return A.tlp_merge(t.bom.select("serial_number", "tlp"), "serial_number")


@query(
    "cwe_top",
    "SELECT cwe, count(*) AS n, max(score) AS max_score FROM vulnerability GROUP BY 1 ORDER BY n DESC, cwe LIMIT 20",
    "vulnerability",
)
def _(t):
    return A.cwe_top(t.vulnerability, 20)


@query(
    "supplier_concentration",
    """s AS (SELECT type, supplier_id, count(*) AS n FROM component GROUP BY 1, 2)
SELECT type, count(*) AS n_suppliers, round(max(n) / sum(n), 6) AS top_share, round(sum(n * n) / (sum(n) * sum(n)), 6) AS herfindahl FROM s GROUP BY 1""",
    "component",
)
def _(t):
    return A.supplier_concentration(t.component)


@query(
    "score_percentiles",
    "SELECT source_name, "
    + ", ".join(f"round(quantile_cont(score, {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95))
    + " FROM vulnerability GROUP BY 1",
    "vulnerability",
)
def _(t):
    return A.score_percentiles(t.vulnerability, "source_name")


@query(
    "hash_alg_usage",
    "SELECT 'MD5' AS alg, count(DISTINCT bom_id) AS n_boms, count(*) AS n_hashes, true AS weak FROM component",
    "component",
)
def _(t):
    return A.hash_alg_usage(t.component.select("bom_id", F.lit("MD5").alias("alg")))


TYPES = "library framework application container file machine-learning-model".split()


@query(
    "reference_pivot",
    "SELECT bom_id, " + ", ".join(f"count(*) FILTER (type = '{v}') AS {v.replace('-', '_')}" for v in TYPES) + " FROM component GROUP BY 1",
    "component",
)
def _(t):
    return A.reference_pivot(t.component, "bom_id", "type", TYPES)


@query(
    "workflow_durations",
    """SELECT state, CAST(sum(epoch(not_valid_after) - epoch(not_valid_before)) AS BIGINT) AS total_seconds,
round(avg(epoch(not_valid_after) - epoch(not_valid_before)), 6) AS mean_seconds, count(*) AS n FROM certificate GROUP BY 1""",
    "certificate",
)
def _(t):
    return A.workflow_durations(t.certificate, "state", "not_valid_before", "not_valid_after")


@query(
    "noisy_or",
    """SELECT requirement_id, round(CASE WHEN max(confidence_score) >= 1.0 THEN 1.0 ELSE 1.0 - exp(coalesce(sum(ln(1.0 - confidence_score)) FILTER (confidence_score < 1.0), 0.0)) END, 6) AS combined
FROM attestation_map GROUP BY 1""",
    "attestation_map",
)
def _(t):
    return A.noisy_or(t.attestation_map, ["requirement_id"], "confidence_score")


@query("algorithm_families", "SELECT DISTINCT type AS family FROM component ORDER BY 1", "component")
def _(t):
    return t.component.select(F.col("type").alias("family")).distinct().orderBy("family")


@query(
    "merge_boms",
    """t AS (SELECT serial_number, max(CASE tlp WHEN 'CLEAR' THEN 0 WHEN 'GREEN' THEN 1 WHEN 'AMBER' THEN 2 WHEN 'AMBER_AND_STRICT' THEN 3 ELSE 4 END) AS r FROM bom GROUP BY 1),
c AS (SELECT b.serial_number, c.purl AS identity, count(*) AS n_merged, arg_min(concat(CAST(c.bom_id AS VARCHAR), ':', c.bom_ref), {'b': c.bom_id, 'r': c.bom_ref}) AS bom_ref FROM component c JOIN bom b ON b.bom_id = c.bom_id GROUP BY 1, 2)
SELECT c.serial_number, identity, bom_ref, n_merged, CASE r WHEN 0 THEN 'CLEAR' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'AMBER' WHEN 3 THEN 'AMBER_AND_STRICT' ELSE 'RED' END AS tlp
FROM c JOIN t ON t.serial_number = c.serial_number""",
    "bom component",
)
def _(t):
    return sets.merge_boms(t.bom.select("bom_id", "serial_number", "tlp"), t.component, "serial_number")


PAIR_SQL = """a AS (SELECT c.comp_group, c.name, c.version FROM component c JOIN bom b ON b.bom_id = c.bom_id WHERE b.lifecycle_phase = 'build'),
z AS (SELECT c.comp_group, c.name, c.version FROM component c JOIN bom b ON b.bom_id = c.bom_id WHERE b.lifecycle_phase = 'operations') """


def _pair(t):
    c = t.component.select("bom_id", "comp_group", "name", "version").join(
        t.bom.select("bom_id", "lifecycle_phase"), "bom_id"
    )
    pick = lambda p: c.filter(F.col("lifecycle_phase") == p).select("comp_group", "name", "version")
    return pick("build"), pick("operations")


@query("common_components", PAIR_SQL + "SELECT * FROM a INTERSECT SELECT * FROM z", "bom component")
def _(t):
    return sets.common_components(*_pair(t))


@query("common_components_all", PAIR_SQL + "SELECT * FROM a INTERSECT ALL SELECT * FROM z", "bom component")
def _(t):
    return sets.common_components_all(*_pair(t))


@query("only_in_first", PAIR_SQL + "SELECT * FROM a EXCEPT ALL SELECT * FROM z", "bom component")
def _(t):
    return sets.only_in_first(*_pair(t))


@query(
    "symmetric_difference",
    PAIR_SQL + "SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM z) x UNION ALL SELECT *, 'second' FROM (SELECT * FROM z EXCEPT ALL SELECT * FROM a) y",
    "bom component",
)
def _(t):
    return sets.symmetric_difference(*_pair(t))


@query(
    "unify_versions",
    """SELECT spec_version, tlp, CASE WHEN spec_version = '1.7' THEN lifecycle_phase END AS lifecycle_phase, count(*) AS n FROM
(SELECT spec_version, CASE WHEN spec_version >= '1.6' THEN tlp END AS tlp, lifecycle_phase FROM bom) x GROUP BY 1, 2, 3""",
    "bom",
)
def _(t):
    b = t.bom
    # older documents do not have the later columns
    old = b.filter("spec_version < '1.6'").select("bom_id", "spec_version")
    mid = b.filter("spec_version = '1.6'").select("bom_id", "spec_version", "tlp")
    new = b.filter("spec_version = '1.7'").select("bom_id", "spec_version", "tlp", "lifecycle_phase")
    return sets.unify_versions([old, mid, new]).groupBy("spec_version", "tlp", "lifecycle_phase").agg(F.count("*").alias("n"))
