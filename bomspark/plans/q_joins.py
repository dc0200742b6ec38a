"""Queries for the join operators."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators.skew import newest_per_key
from ..operators.windows import latest_bom
from .registry import query

MAJOR = "CAST(split_part(version, '.', 1) AS INT)"
LO = "CAST(split_part(split_part(vers_range, '>=', 2), '.', 1) AS INT)"
HI = "CAST(split_part(split_part(vers_range, '<', 2), '.', 1) AS INT)"


@query(
    "flagship_open_risk",
    f"""latest AS (SELECT bom_id FROM (SELECT bom_id, row_number() OVER (PARTITION BY serial_number ORDER BY version DESC) rn FROM bom) x WHERE rn = 1),
open_v AS (SELECT package_id, score, {LO} AS lo, {HI} AS hi FROM vulnerability
           WHERE severity IN ('critical', 'high') AND analysis_state IN ('exploitable', 'in_triage'))
SELECT c.comp_group, c.name, o.region, count(DISTINCT c.bom_id) AS n_boms, max(v.score) AS max_score
FROM latest l JOIN component c ON c.bom_id = l.bom_id
JOIN open_v v ON v.package_id = c.package_id AND CAST(split_part(c.version, '.', 1) AS INT) >= v.lo
     AND CAST(split_part(c.version, '.', 1) AS INT) < v.hi
JOIN organization o ON o.supplier_id = c.supplier_id
GROUP BY 1, 2, 3 ORDER BY n_boms DESC, comp_group, name, region LIMIT 20""",
    "bom component vulnerability organization",
)
def flagship(t):
    open_v = t.vulnerability.filter(
        F.col("severity").isin("critical", "high") & F.col("analysis_state").isin("exploitable", "in_triage")
    )
    latest = latest_bom(t.bom).select("bom_id")
    c = t.component.select("bom_id", "comp_group", "name", "version", "package_id", "supplier_id")
    # distinct package versions meet the ranges first; the components then join on an exact key
    at_risk = J.match_vulnerabilities(c, open_v).groupBy("package_id", "version").agg(F.max("max_score").alias("score"))
    return (
        c.join(at_risk, ["package_id", "version"]).join(latest, "bom_id")
        .join(t.organization.select("supplier_id", "region"), "supplier_id")
        .groupBy("comp_group", "name", "region", "bom_id").agg(F.max("score").alias("score"))
        .groupBy("comp_group", "name", "region")
        .agg(F.count("*").alias("n_boms"), F.max("score").alias("max_score"))
        .orderBy(F.desc("n_boms"), "comp_group", "name", "region").limit(20)
    )


@query(
    "filter_inventory",
    """SELECT bom_id, bom_ref, type, name, version FROM component
WHERE type IN ('library', 'framework') AND coalesce(scope, 'required') = 'required' AND NOT is_external""",
    "component",
)
def _(t):
    got = J.filter_inventory(t.component, types=["library", "framework"], scopes=["required"], external=False)
    return got.select("bom_id", "bom_ref", "type", "name", "version")


@query(
    "resolve_refs",
    """declared AS (SELECT DISTINCT bom_id, bom_ref FROM component)
SELECT e.bom_id, e.ref, e.target, CASE WHEN d.bom_ref IS NULL THEN NULL ELSE 'component' END AS element_type
FROM doc_edge e LEFT JOIN declared d ON d.bom_id = e.bom_id AND d.bom_ref = e.target""",
    "component doc_edge",
)
def _(t):
    refs = t.component.select("bom_id", F.col("bom_ref").alias("ref"), F.lit("component").alias("element_type"))
    return J.resolve_refs(t.doc_edge, refs).select("bom_id", "ref", "target", "element_type")


@query(
    "resolve_bom_links",
    """p AS (SELECT from_bom, from_ref, link, substr(link, 9, 36) AS u, CAST(split_part(split_part(link, '/', 2), '#', 1) AS INT) AS v FROM bom_link)
SELECT p.from_bom, p.from_ref, p.link, b.bom_id AS to_bom, true AS resolved FROM p JOIN bom b ON substr(b.serial_number, 10) = p.u AND b.version = p.v""",
    "bom component bom_link",
)
def _(t):
    refs = t.component.select("bom_id", F.col("bom_ref").alias("ref"))
    return J.resolve_bom_links(t.bom_link, t.bom, refs).select("from_bom", "from_ref", "link", "to_bom", "resolved")


@query(
    "unresolved_bom_links",
    """p AS (SELECT from_bom, from_ref, link, substr(link, 9, 36) AS u, CAST(split_part(split_part(link, '/', 2), '#', 1) AS INT) AS v FROM bom_link)
SELECT from_bom, from_ref, link FROM p WHERE NOT EXISTS (SELECT 1 FROM bom b WHERE substr(b.serial_number, 10) = p.u AND b.version = p.v)""",
    "bom component bom_link",
)
def _(t):
    return J.unresolved_bom_links(t.bom_link, t.bom).select("from_bom", "from_ref", "link")


@query(
    "graph_absent_components",
    "SELECT DISTINCT depends_on AS ref FROM dependency_edge WHERE depends_on NOT IN (SELECT ref FROM dependency_edge)",
    "dependency_edge",
)
def _(t):
    nodes = t.dependency_edge.select(F.col("depends_on").alias("ref")).distinct()
    return J.graph_absent_components(nodes, t.dependency_edge)


@query(
    "leaf_components",
    """SELECT bom_id, ref FROM doc_edge e GROUP BY bom_id, ref
HAVING NOT bool_or(EXISTS (SELECT 1 FROM component c WHERE c.bom_id = e.bom_id AND c.bom_ref = e.target))""",
    "component doc_edge",
)
def _(t):
    # a component whose only edge leads nowhere is declared with an empty list
    refs = t.component.select("bom_id", F.col("bom_ref").alias("ref"), F.lit("component").alias("element_type"))
    edges = J.resolve_refs(t.doc_edge, refs).withColumn("declared_empty", F.col("element_type").isNull())
    return J.leaf_components(edges)


@query(
    "boms_containing",
    """wanted AS (SELECT DISTINCT package_id FROM vulnerability WHERE severity = 'critical')
SELECT bom_id, serial_number, version FROM bom WHERE bom_id IN
(SELECT bom_id FROM component WHERE package_id IN (SELECT package_id FROM wanted))""",
    "bom component vulnerability",
)
def _(t):
    wanted = t.vulnerability.filter("severity = 'critical'")
    got = J.boms_containing(t.bom, t.component, wanted, "package_id")
    return got.select("bom_id", "serial_number", "version")


@query(
    "affected_components",
    """SELECT v.source_name, v.severity, c.type, count(*) AS n_affected FROM
(SELECT source_name, severity, package_id FROM vulnerability) v JOIN component c ON c.package_id = v.package_id GROUP BY 1, 2, 3""",
    "component vulnerability",
)
def _(t):
    # counts on both sides first: the pairs are multiplied, not listed
    v = t.vulnerability.groupBy("package_id", "source_name", "severity").agg(F.count("*").alias("nv"))
    c = t.component.groupBy("package_id", "type").agg(F.count("*").alias("nc"))
    return v.join(c, "package_id").groupBy("source_name", "severity", "type").agg(
        F.sum(F.col("nv") * F.col("nc")).alias("n_affected")
    )


@query(
    "affected_components_by_ref",
    """a AS (SELECT bom_id, concat('V-', CAST(package_id AS VARCHAR)) AS vuln_id, bom_ref AS ref FROM component WHERE package_id % 9 = 0
UNION ALL SELECT bom_id, 'V-lost', 'gone' FROM bom)
SELECT a.bom_id, vuln_id, a.ref, c.name, c.version FROM a LEFT JOIN component c ON c.bom_id = a.bom_id AND c.bom_ref = a.ref""",
    "bom component",
)
def _(t):
    named = t.component.filter("package_id % 9 = 0").select("bom_id", F.concat(F.lit("V-"), F.col("package_id").cast("string")).alias("vuln_id"), F.col("bom_ref").alias("ref"))
    lost = t.bom.select("bom_id", F.lit("V-lost").alias("vuln_id"), F.lit("gone").alias("ref"))
    got = J.affected_components(named.unionByName(lost), t.component.select("bom_id", "bom_ref", "name", "version"))
    return got.select("bom_id", "vuln_id", "ref", "name", "version")


@query(
    "match_vulnerabilities",
    f"""pv AS (SELECT package_id, version, count(*) AS n_components FROM component GROUP BY 1, 2),
r AS (SELECT package_id, vers_range, count(*) AS n_vulns, max(score) AS max_score, {LO} AS lo, {HI} AS hi FROM vulnerability GROUP BY ALL)
SELECT pv.package_id, version, vers_range, n_components, n_vulns, max_score FROM pv JOIN r ON pv.package_id = r.package_id
AND {MAJOR} >= lo AND {MAJOR} < hi""",
    "component vulnerability",
)
def _(t):
    return J.match_vulnerabilities(t.component, t.vulnerability)


@query(
    "vulnerability_status",
    f"""pv AS (SELECT DISTINCT package_id, version FROM component),
ex AS (SELECT DISTINCT package_id, concat(CAST(cwe % 50 + 1 AS VARCHAR), '.1.0') AS version,
       CASE WHEN analysis_state IN ('not_affected', 'false_positive') THEN 'unaffected' WHEN analysis_state = 'in_triage' THEN 'unknown' ELSE 'affected' END AS status FROM vulnerability),
m AS (SELECT pv.package_id, pv.version, ex.status, 1 AS s FROM pv JOIN ex ON pv.package_id = ex.package_id AND pv.version = ex.version
  UNION ALL SELECT pv.package_id, pv.version, 'affected', 0 FROM pv JOIN (SELECT DISTINCT package_id, {LO} AS lo, {HI} AS hi FROM vulnerability) r
    ON r.package_id = pv.package_id AND {MAJOR} >= lo AND {MAJOR} < hi)
SELECT package_id, version, status FROM (SELECT *, row_number() OVER (PARTITION BY package_id, version ORDER BY s DESC,
  CASE status WHEN 'affected' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END DESC) AS rn FROM m) x WHERE rn = 1""",
    "component vulnerability",
)
def _(t):
    v = t.vulnerability
    none = F.lit(None).cast("string")
    ranges = v.select("package_id", none.alias("version"), "vers_range", none.alias("status"))
    exact = v.select(
        "package_id", F.concat((F.col("cwe") % 50 + 1).cast("string"), F.lit(".1.0")).alias("version"),
        none.alias("vers_range"),
        F.when(F.col("analysis_state").isin("not_affected", "false_positive"), "unaffected")
        .when(F.col("analysis_state") == "in_triage", "unknown").alias("status"),
    )
    return J.vulnerability_status(t.component, ranges.unionByName(exact))


@query(
    "apply_vex",
    """inv AS (SELECT package_id, count(*) AS n_components FROM component GROUP BY 1),
a AS (SELECT * FROM (SELECT package_id, source_name, analysis_state, row_number() OVER (PARTITION BY package_id, source_name ORDER BY published_at DESC, vuln_key DESC) AS rn FROM vulnerability) x WHERE rn = 1)
SELECT inv.package_id, n_components, source_name, analysis_state FROM inv LEFT JOIN a ON a.package_id = inv.package_id""",
    "component vulnerability",
)
def _(t):
    inv = t.component.groupBy("package_id").agg(F.count("*").alias("n_components"))
    return J.apply_vex(inv, t.vulnerability)


@query(
    "observed_vs_concluded",
    """d AS (SELECT DISTINCT package_id, license_id AS declared FROM component),
o AS (SELECT doc_id AS package_id, observed_license AS observed FROM attached_text WHERE observed_license IS NOT NULL)
SELECT coalesce(d.package_id, o.package_id) AS package_id, declared, observed,
CASE WHEN declared IS NULL THEN 'observed_only' WHEN observed IS NULL THEN 'declared_only' WHEN declared = observed THEN 'agree' ELSE 'conflict' END AS verdict
FROM d FULL JOIN o ON d.package_id = o.package_id""",
    "component attached_text",
)
def _(t):
    d = t.component.select("package_id", F.col("license_id").alias("declared")).distinct()
    o = t.attached_text.filter("observed_license IS NOT NULL").select(
        F.col("doc_id").alias("package_id"), F.col("observed_license").alias("observed")
    )
    return J.observed_vs_concluded(d, o)


POLICY = {"Apache-2.0": "allow", "MIT": "allow", "CC-BY-NC-4.0": "deny"}


@query(
    "license_policy",
    """SELECT type, license_id, CASE WHEN license_id IN ('Apache-2.0', 'MIT') THEN 'allow' WHEN license_id = 'CC-BY-NC-4.0' THEN 'deny' ELSE 'review' END AS decision,
count(*) AS n FROM component GROUP BY 1, 2, 3""",
    "component",
)
def _(t):
    return J.license_policy(t.component, POLICY).groupBy("type", "license_id", "decision").agg(F.count("*").alias("n"))


@query(
    "identity_by_hash",
    """SELECT 'MD5' AS alg, hash_md5 AS value, count(DISTINCT bom_id) AS n_boms, count(*) AS n_components, min(bom_id) AS first_bom, max(bom_id) AS last_bom
FROM component GROUP BY 2 HAVING count(DISTINCT bom_id) > 1""",
    "component",
)
def _(t):
    return J.identity_by_hash(t.component.select("bom_id", F.lit("MD5").alias("alg"), F.col("hash_md5").alias("value")))


AS_OF = "1998-07-01 00:00:00"


@query(
    "bom_as_of",
    f"""SELECT serial_number, bom_id, version, created_at FROM (SELECT *, row_number() OVER (PARTITION BY serial_number ORDER BY created_at DESC, version DESC) AS rn
FROM bom WHERE created_at <= TIMESTAMP '{AS_OF}') x WHERE rn = 1""",
    "bom",
)
def _(t):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return J.bom_as_of(t.bom, at).select("serial_number", "bom_id", "version", "created_at")


@query(
    "bom_as_of_each",
    """p AS (SELECT bom_id AS point_id, serial_number, created_at + INTERVAL '45' DAY AS at FROM bom)
SELECT p.point_id, p.serial_number, p.at, max(b.version) AS version FROM p JOIN bom b ON b.serial_number = p.serial_number AND b.created_at <= p.at GROUP BY 1, 2, 3""",
    "bom",
)
def _(t):
    p = t.bom.select(
        F.col("bom_id").alias("point_id"), "serial_number", (F.col("created_at") + F.expr("INTERVAL '45' DAY")).alias("at")
    )
    return J.bom_as_of_each(p, t.bom)


def open_ended(certificates):
    """Every fifth certificate without an end."""
    return certificates.withColumn("not_valid_after", F.when(F.col("cert_id") % 5 != 0, F.col("not_valid_after")))


@query(
    "valid_at",
    f"""SELECT cert_id, subject_name, state FROM certificate WHERE not_valid_before <= TIMESTAMP '{AS_OF}' AND (cert_id % 5 = 0 OR not_valid_after >= TIMESTAMP '{AS_OF}')""",
    "certificate",
)
def _(t):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return J.valid_at(open_ended(t.certificate), "not_valid_before", "not_valid_after", at).select("cert_id", "subject_name", "state")


@query(
    "valid_during",
    """SELECT state, count(*) AS n FROM certificate WHERE not_valid_before <= TIMESTAMP '1998-12-31' AND not_valid_after >= TIMESTAMP '1998-01-01' GROUP BY 1""",
    "certificate",
)
def _(t):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1998-01-01", "1998-12-31"))
    got = J.valid_during(t.certificate, "not_valid_before", "not_valid_after", lo, hi)
    return got.groupBy("state").agg(F.count("*").alias("n"))


@query(
    "valid_interval_join",
    """p AS (SELECT concat('CN=', CAST(c_custkey AS VARCHAR)) AS subject_name, TIMESTAMP '1997-01-01' + INTERVAL (c_custkey % 1000) DAY AS at FROM customer)
SELECT p.subject_name, p.at, c.cert_id FROM p JOIN certificate c ON c.subject_name = p.subject_name AND c.not_valid_before <= p.at AND (c.cert_id % 5 = 0 OR c.not_valid_after >= p.at)""",
    "certificate",
)
def _(t):
    p = t.raw("customer").select(
        F.concat(F.lit("CN="), F.col("c_custkey").cast("string")).alias("subject_name"),
        (F.lit("1997-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 1000).cast("int"))).alias("at"),
    )
    c = open_ended(t.certificate).select("subject_name", "cert_id", "not_valid_before", "not_valid_after")
    return J.interval_join(p, c, "subject_name", "not_valid_before", "not_valid_after").select("subject_name", "at", "cert_id")


@query(
    "task_overlap",
    """SELECT a.cert_id, count(*) - 1 AS n_overlapping FROM certificate a JOIN certificate b ON a.subject_name = b.subject_name
AND b.not_valid_before <= a.not_valid_after AND b.not_valid_after >= a.not_valid_before GROUP BY 1""",
    "certificate",
)
def _(t):
    got = J.task_overlap(t.certificate, "subject_name", "not_valid_before", "not_valid_after")
    return got.select("cert_id", "n_overlapping")


@query(
    "bom_diff",
    """prev AS (SELECT bom_id, serial_number, version, lag(bom_id) OVER (PARTITION BY serial_number ORDER BY version) AS p, max(version) OVER (PARTITION BY serial_number) AS mv FROM bom),
last2 AS (SELECT serial_number, bom_id, p FROM prev WHERE version = mv AND p IS NOT NULL),
o AS (SELECT l.serial_number, split_part(c.purl, '@', 1) AS package, string_agg(DISTINCT c.version, ',' ORDER BY c.version) AS old_version FROM last2 l JOIN component c ON c.bom_id = l.p GROUP BY 1, 2),
n AS (SELECT l.serial_number, split_part(c.purl, '@', 1) AS package, string_agg(DISTINCT c.version, ',' ORDER BY c.version) AS new_version FROM last2 l JOIN component c ON c.bom_id = l.bom_id GROUP BY 1, 2),
j AS (SELECT coalesce(o.serial_number, n.serial_number) AS serial_number, coalesce(o.package, n.package) AS package, old_version, new_version FROM o FULL JOIN n ON o.serial_number = n.serial_number AND o.package = n.package)
SELECT *, CASE WHEN old_version IS NULL THEN 'added' WHEN new_version IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j WHERE old_version IS DISTINCT FROM new_version""",
    "bom component",
)
def _(t):
    newest = newest_per_key(
        J.previous_documents(t.bom).select("serial_number", "version", "bom_id", "previous_bom"), ["serial_number"], [F.col("version")]
    ).filter("previous_bom IS NOT NULL")
    c = t.component.select("bom_id", S.purl_without_version("purl").alias("package"), "version")
    new = newest.select("serial_number", "bom_id").join(c, "bom_id")
    old = newest.select("serial_number", F.col("previous_bom").alias("bom_id")).join(c, "bom_id")
    return J.bom_diff(old, new, ["serial_number", "package"])


@query(
    "claims_for_requirement",
    """SELECT p_partkey AS requirement_id, p_brand AS level, country, CAST(sum(CASE WHEN counter_claim THEN 0 ELSE 1 END) AS BIGINT) AS n_claims,
CAST(sum(CASE WHEN counter_claim THEN 1 ELSE 0 END) AS BIGINT) AS n_counter_claims
FROM part JOIN attestation_map ON requirement_id = p_partkey JOIN organization ON supplier_id = assessor_id GROUP BY 1, 2, 3""",
    "attestation_map organization",
)
def _(t):
    req = t.package.select(F.col("package_id").alias("requirement_id"), F.col("brand").alias("level"))
    org = t.organization.select(F.col("supplier_id").alias("assessor_id"), "country")
    got = J.claims_for_requirement(req, t.attestation_map, org)
    return got.groupBy("requirement_id", "level", "country").agg(
        F.sum("n_claims").alias("n_claims"), F.sum("n_counter_claims").alias("n_counter_claims")
    )


@query(
    "uncovered_requirements",
    """SELECT p_partkey AS requirement_id, p_brand AS level FROM part WHERE p_partkey NOT IN
(SELECT requirement_id FROM attestation_map WHERE NOT counter_claim AND conformance_score >= 0.95)""",
    "attestation_map",
)
def _(t):
    req = t.package.select(F.col("package_id").alias("requirement_id"), F.col("brand").alias("level"))
    return J.uncovered_requirements(req, t.attestation_map, 0.95)


@query(
    "supplier_geography",
    """SELECT region, country, count(DISTINCT c.supplier_id) AS n_suppliers, count(*) AS n_components
FROM component c JOIN organization o ON o.supplier_id = c.supplier_id GROUP BY 1, 2""",
    "component organization",
)
def _(t):
    return J.supplier_geography(t.component, t.organization)
