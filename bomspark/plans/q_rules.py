"""Queries for the rules. Row rules run over the tables with defects the data
has or that follow from a key; document rules run over derived documents."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import enums as en
from ..operators import aggs as A, flatten as X, rules as R
from . import corpus as C
from .q_docs import CIT
from ..sources.documents import typed
from .registry import query

V = "SELECT {bom} AS bom_id, '{rule}' AS rule, '{sev}' AS severity, {ptr} AS pointer, {val} AS value FROM "


def head(rule, ptr, val, sev="error", bom="bom_id"):
    return V.format(bom=bom, rule=rule, sev=sev, ptr=ptr, val=val)


def lacking(t):
    """Components with the gaps that keys decide."""
    return t.component.select(
        "bom_id", "bom_ref", F.when(F.col("package_id") % 50 != 0, F.col("name")).alias("name"),
        F.when(F.col("supplier_id") % 40 != 0, F.col("type")).alias("type"),
    )


@query(
    "rule_required",
    head("required", "bom_ref", "'name'") + "component WHERE package_id % 50 = 0 UNION ALL "
    + head("required", "bom_ref", "'type'") + "component WHERE supplier_id % 40 = 0",
    "component",
)
def _(t):
    return R.check_rows(lacking(t), R.required("type", "name"), "bom_ref")


@query(
    "rule_enum",
    head("enum", "bom_ref", "concat('type=', type)", bom="c.bom_id") + "component c JOIN bom b ON b.bom_id = c.bom_id WHERE type = 'machine-learning-model' AND spec_version < '1.5'",
    "bom component",
)
def _(t):
    c = t.component.select("bom_id", "bom_ref", "type", "scope").join(t.bom.select("bom_id", "spec_version"), "bom_id")
    return R.check_rows(c, [R.enum("type", "component_type"), R.enum("scope", "scope")], "bom_ref")


@query("rule_license_id", head("license_id", "bom_ref", "license_id") + "component WHERE license_id = 'Apache-2'", "component")
def _(t):
    known = t.spark.createDataFrame([(x,) for x in ("Apache-2.0", "MIT", "GPL-3.0-only", "CC-BY-NC-4.0")], "license_id string")
    return R.license_ids(t.component.select("bom_id", F.col("bom_ref").alias("pointer"), "license_id"), known)


@query(
    "rule_pattern",
    head("pattern", "'/serialNumber'", "upper(serial_number)") + "bom WHERE bom_id % 100 = 0 UNION ALL "
    + head("pattern", "bom_ref", "substr(hash_md5, 2)") + "component WHERE package_id % 100 = 0",
    "bom component",
)
def _(t):
    serial = F.when(F.col("bom_id") % 100 == 0, F.upper("serial_number")).otherwise(F.col("serial_number"))
    b = t.bom.select("bom_id", serial.alias("serial_number"))
    h = F.when(F.col("package_id") % 100 == 0, F.substring("hash_md5", 2, 31)).otherwise(F.col("hash_md5"))
    c = t.component.select("bom_id", "bom_ref", h.alias("hash"))
    return R.union([
        R.check_rows(b, [R.pattern("serial_number", "serial")], F.lit("/serialNumber")), R.check_rows(c, [R.pattern("hash", "hash")], "bom_ref"),
    ])


@query(
    "rule_range",
    head("range", "concat('r-', CAST(requirement_id AS VARCHAR))", "concat('conformance=', CAST(CAST(round(conformance_score * 10) AS INT) AS VARCHAR))", bom="attestation_id")
    + "attestation_map WHERE round(conformance_score * 10) > 9",
    "attestation_map",
)
def _(t):
    m = t.attestation_map.select(
        F.col("attestation_id").alias("bom_id"), F.concat(F.lit("r-"), F.col("requirement_id").cast("string")).alias("pointer"),
        F.round(F.col("conformance_score") * 10).cast("int").alias("conformance"), "confidence_score",
    )
    return R.check_rows(m, [R.bounded("conformance", 0, 9), R.bounded("confidence_score", 0, 1)])


@query("rule_length", head("length", "bom_ref", "'name'") + "component WHERE length(name) > 10 OR length(name) < 8", "component")
def _(t):
    return R.check_rows(t.component.select("bom_id", "bom_ref", "name", "version"), [R.length("name", 8, 10), R.length("version", 0, 1024)], "bom_ref")


@query(
    "rule_choice",
    head("choice", "bom_ref", "concat('license=', CASE WHEN package_id % 10 = 0 THEN '2' ELSE '0' END)") + "component WHERE package_id % 10 IN (0, 5)",
    "component",
)
def _(t):
    k = F.col("package_id") % 10
    c = t.component.select(
        "bom_id", "bom_ref", F.when(k != 5, F.col("license_id")).alias("id"), F.when(k == 0, F.col("license_id")).alias("label")
    )
    return R.check_rows(c, [R.choice("license", F.col("id"), F.col("label"))], "bom_ref")


@query(
    "rule_version_range",
    head("version_range", "bom_ref", "'version and versionRange'") + "component WHERE package_id % 7 = 0 AND package_id % 2 = 0 UNION ALL "
    + head("version_range", "bom_ref", "'versionRange on a part that is not external'") + "component WHERE package_id % 7 = 0 AND NOT is_external",
    "component",
)
def _(t):
    k = F.col("package_id")
    c = t.component.select(
        "bom_id", "bom_ref", F.when((k % 7 != 0) | (k % 2 == 0), F.col("version")).alias("version"),
        F.when(k % 7 == 0, F.lit("vers:generic/>=1.0")).alias("version_range"), "is_external", F.lit("inventory").alias("role"),
    )
    return R.check_rows(c, R.version_range_rules(), "bom_ref")


@query(
    "rule_type_specific",
    "SELECT CAST(p_partkey // 25 AS BIGINT) AS bom_id, 'type_specific' AS rule, 'error' AS severity, concat('d-', CAST(p_partkey AS VARCHAR)) AS pointer, 'data' AS value FROM part WHERE p_type = 'PROMO'",
)
def _(t):
    el = X.component_elements(C.data_docs(t), ("inventory",))
    # documents keep their sections; a part of this kind is declared as a library
    c = F.col("c")
    promo = c["data"].isNotNull() & (F.try_variant_get(c["data"], "$[0].classification", "string") == "PROMO")
    el = el.withColumn("c", c.withField("type", F.when(promo, "library").otherwise(c["type"])))
    return R.check_rows(el, R.type_specific_rules(), F.col("c")["bom-ref"])


@query(
    "rule_timestamp",
    head("timestamp", "'/metadata/timestamp'", "concat('timestamp=', strftime(created_at, '%Y-%m-%d'))") + "bom WHERE bom_id % 20 = 0",
    "bom",
)
def _(t):
    day = F.date_format("created_at", "yyyy-MM-dd")
    text = F.when(F.col("bom_id") % 20 == 0, day).otherwise(F.concat(day, F.lit("T00:00:00Z")))
    return R.check_rows(t.bom.select("bom_id", text.alias("t")), [R.date_time(F.col("t"), "timestamp")], F.lit("/metadata/timestamp"))


@query(
    "rule_unknown_field",
    head("unknown_field", "'/metadata'", "'metadata.' || k") + "(SELECT bom_id, unnest(CASE WHEN spec_version >= '1.7' THEN [] WHEN tlp = 'CLEAR' THEN CASE WHEN spec_version < '1.5' THEN ['lifecycles'] ELSE [] END "
    "WHEN spec_version < '1.5' THEN ['distributionConstraints', 'lifecycles'] ELSE ['distributionConstraints'] END) AS k FROM bom) x UNION ALL "
    + head("unknown_field", "bom_ref", "'component.isExternal'", bom="c.bom_id") + "component c JOIN bom b ON b.bom_id = c.bom_id WHERE is_external AND spec_version < '1.7' UNION ALL "
    + head("unknown_field", "bom_ref", "'component.omniborId'", bom="c.bom_id") + "component c JOIN bom b ON b.bom_id = c.bom_id WHERE package_id % 7 = 0 AND spec_version < '1.6'",
    "bom component",
)
def _(t):
    docs = C.component_docs(t)
    el = X.component_elements(docs, ("main", "inventory"), with_members=True, taken=("bom-ref",)).withColumn("pointer", F.col("c")["bom-ref"])
    return R.unknown_fields(docs, el)


@query(
    "rule_ref_unique",
    "SELECT bom_id, 'ref_unique' AS rule, 'error' AS severity, bom_ref AS pointer, bom_ref AS value FROM component GROUP BY bom_id, bom_ref HAVING count(*) > 1",
    "component",
)
def _(t):
    return R.ref_unique(t.component.select("bom_id", F.col("bom_ref").alias("ref"), F.col("bom_ref").alias("pointer")))


@query(
    "rule_ref_dangling",
    """SELECT e.bom_id, 'ref_dangling' AS rule, 'warning' AS severity, 'dependsOn' AS pointer, e.target AS value FROM doc_edge e
WHERE NOT EXISTS (SELECT 1 FROM component c WHERE c.bom_id = e.bom_id AND c.bom_ref = e.target)""",
    "component doc_edge",
)
def _(t):
    uses = t.doc_edge.select("bom_id", F.lit("dependsOn").alias("field"), "target")
    return R.ref_dangling(uses, t.component.select("bom_id", F.col("bom_ref").alias("ref")))


@query(
    "rule_ref_link_prefix",
    head("ref_link_prefix", "'ref'", "link", "warning", "from_bom") + "bom_link WHERE from_bom % 10 = 0",
    "bom_link",
)
def _(t):
    ref = F.when(F.col("from_bom") % 10 == 0, F.col("link")).otherwise(F.col("from_ref"))
    b = t.bom_link.select(F.col("from_bom").alias("bom_id"), ref.alias("ref"))
    return R.check_rows(b, [R.ref_link_prefix("ref")], F.lit("ref"))


@query(
    "rule_citation_source",
    CIT + " SELECT bom_id, 'citation_source' AS rule, 'error' AS severity, '/citations/0' AS pointer, 'no source' AS value FROM c WHERE bom_id % 3 = 0",
)
def _(t):
    return R.citation_source(C.citation_docs(t))


@query(
    "rule_requirement_parent",
    """p AS (SELECT CAST(p_partkey // 64 AS BIGINT) AS bom_id, p_partkey AS k, p_partkey % 64 AS i, p_partkey // 64 * 64 + (p_partkey % 64 - 1) // 2 AS parent FROM part)
SELECT bom_id, 'requirement_parent' AS rule, 'error' AS severity, concat('r-', CAST(k AS VARCHAR)) AS pointer, concat('r-', CAST(parent AS VARCHAR)) AS value FROM p WHERE i > 0 AND parent % 64 = 3 AND k % 64 <> 3""",
)
def _(t):
    req = X.explode_standards(C.standard_docs(t))["requirement"]
    # the fourth requirement of each standard was withdrawn
    return R.requirement_parent(req.filter("identifier <> 'R.3'"))


@query(
    "rule_serial_unique",
    """x AS (SELECT bom_id, serial_number, CASE WHEN version % 10 = 0 THEN version - 1 ELSE version END AS version FROM bom)
SELECT min(bom_id) AS bom_id, 'serial_unique' AS rule, 'error' AS severity, '/serialNumber' AS pointer, concat(serial_number, '/', CAST(version AS VARCHAR)) AS value FROM x GROUP BY serial_number, version HAVING count(*) > 1""",
    "bom",
)
def _(t):
    # a publisher that forgot to count up: every tenth version repeats the number before
    v = F.when(F.col("version") % 10 == 0, F.col("version") - 1).otherwise(F.col("version"))
    b = t.bom.select("bom_id", "serial_number", v.alias("version"), S.content_hash("bom_id", "created_at").alias("content_hash"))
    return R.serial_unique(b)


@query(
    "rule_vex_justification",
    head("vex_justification", "concat('v-', CAST(vuln_key AS VARCHAR))", "analysis_state", "warning", "CAST(vuln_key // 10 AS BIGINT)")
    + "vulnerability WHERE (analysis_state = 'not_affected' AND vuln_key % 4 <> 1) OR (analysis_state = 'exploitable' AND vuln_key % 3 <> 2)",
    "vulnerability",
)
def _(t):
    d = X.explode_vulnerabilities(C.vulnerability_docs(t))
    a = d["analysis"].withColumn("k", F.concat(F.lit("v-"), (F.col("bom_id") * 10 + F.col("position")).cast("string")))
    return R.check_rows(a, R.vex_rules(), "k")


@query(
    "rule_deprecated",
    " UNION ALL ".join([
        f"SELECT CAST(o_orderkey // 10 AS BIGINT) AS bom_id, 'deprecated' AS rule, 'warning' AS severity, concat('{p}-', CAST(o_orderkey AS VARCHAR)) AS pointer, '{n}' AS value FROM orders WHERE {w}"
        for p, n, w in (("alg", "curve", "o_orderkey % 4 = 2"), ("cert", "signatureAlgorithmRef", "true"), ("key", "algorithmRef", "true"))
    ]),
)
def _(t):
    docs = C.crypto_docs(t)
    el = X.component_elements(docs, ("inventory",)).withColumn("pointer", F.col("c")["bom-ref"])
    return R.deprecated_fields(docs, el)


@query(
    "rule_hash_length",
    head("hash_length", "bom_ref", "concat('SHA-1:', '32')", "warning") + "component WHERE package_id % 9 = 0",
    "component",
)
def _(t):
    alg = F.when(F.col("package_id") % 9 == 0, "SHA-1").otherwise("MD5")
    c = t.component.select("bom_id", "bom_ref", alg.alias("alg"), F.col("hash_md5").alias("value"))
    return R.check_rows(c, [R.hash_length()], "bom_ref")


@query(
    "rule_date_order",
    head("date_order", "subject_name", "'not_valid_before > not_valid_after'", "warning", "cert_id") + "certificate WHERE not_valid_before > TIMESTAMP '2001-01-01'",
    "certificate",
)
def _(t):
    # no certificate outlives the root, so late ones end before they start
    end = F.least("not_valid_after", F.lit("2001-01-01").cast("timestamp_ntz"))
    c = t.certificate.select(F.col("cert_id").alias("bom_id"), "subject_name", "not_valid_before", end.alias("not_valid_after"))
    return R.check_rows(c, [R.date_order("not_valid_before", "not_valid_after")], "subject_name")


def table_violations(t):
    """Violations of the component table: one pass of row rules and uniqueness."""
    c = t.component.select("bom_id", "bom_ref", "type", "scope", "license_id", "hash_md5").join(t.bom.select("bom_id", "spec_version"), "bom_id")
    known = F.col("license_id").isin("Apache-2.0", "MIT", "GPL-3.0-only", "CC-BY-NC-4.0")
    rows = R.check_rows(
        c,
        [R.enum("type", "component_type"), R.enum("scope", "scope"), R.pattern("hash_md5", "hash"), R.RowRule("license_id", ~known, F.col("license_id"))],
        "bom_ref",
    )
    refs = t.component.select("bom_id", F.col("bom_ref").alias("ref"), F.col("bom_ref").alias("pointer"))
    return R.union([rows, R.ref_unique(refs, R.WARNING)])


VIOL = """v AS (SELECT c.bom_id, 'enum' AS rule, 'error' AS severity, bom_ref AS pointer, concat('type=', type) AS value FROM component c JOIN bom b ON b.bom_id = c.bom_id WHERE type = 'machine-learning-model' AND spec_version < '1.5'
UNION ALL SELECT bom_id, 'license_id', 'error', bom_ref, license_id FROM component WHERE license_id = 'Apache-2'
UNION ALL SELECT bom_id, 'ref_unique', 'warning', bom_ref, bom_ref FROM component GROUP BY bom_id, bom_ref HAVING count(*) > 1)"""


@query(
    "document_verdict",
    VIOL + """, e AS (SELECT bom_id, count(*) AS n_errors, arg_min(rule, {'a': pointer, 'b': rule, 'c': value}) AS first_rule FROM v WHERE severity = 'error' GROUP BY 1)
SELECT b.bom_id, e.bom_id IS NULL AS valid, coalesce(n_errors, 0) AS n_errors, first_rule FROM bom b LEFT JOIN e ON e.bom_id = b.bom_id""",
    "bom component",
)
def _(t):
    return R.document_verdict(t.bom, table_violations(t))


@query(
    "verdict_vs_expected",
    VIOL + """, e AS (SELECT bom_id, arg_min(rule, {'a': pointer, 'b': rule, 'c': value}) AS first_rule FROM v WHERE severity = 'error' GROUP BY 1),
d AS (SELECT b.bom_id, concat(CASE WHEN b.bom_id % 2 = 0 THEN 'valid-' ELSE 'invalid-' END, CAST(b.bom_id AS VARCHAR), '.json') AS file, b.bom_id % 2 = 0 AS expected, e.bom_id IS NULL AS valid, first_rule FROM bom b LEFT JOIN e ON e.bom_id = b.bom_id)
SELECT * FROM d WHERE expected <> valid""",
    "bom component",
)
def _(t):
    name = F.concat(F.lit("/corpus/1.7/"), F.when(F.col("bom_id") % 2 == 0, "valid-").otherwise("invalid-"), F.col("bom_id").cast("string"), F.lit(".json"))
    docs = t.bom.select("bom_id", name.alias("source_path"))
    return R.verdict_vs_expected(R.document_verdict(t.bom, table_violations(t)), docs)


@query(
    "rule_summary",
    VIOL + """ SELECT rule, severity, spec_version, count(*) AS n, CAST(grouping(rule) * 4 + grouping(severity) * 2 + grouping(spec_version) AS BIGINT) AS level
FROM v JOIN bom b ON b.bom_id = v.bom_id GROUP BY ROLLUP (rule, severity, spec_version)""",
    "bom component",
)
def _(t):
    return A.rule_summary(table_violations(t).join(t.bom.select("bom_id", "spec_version"), "bom_id"))


@query(
    "user_rule",
    head("house_style", "bom_ref", "name", "warning") + "component WHERE name LIKE '%gizmo%' AND is_external",
    "component",
)
def _(t):
    rs = R.RuleSet()
    rs.rule("house_style", R.WARNING, lambda c: c.filter("name LIKE '%gizmo%' AND is_external").select("bom_id", F.col("bom_ref").alias("pointer"), F.col("name").alias("value")))
    return rs.run(t.component)


_HEAD = '{"specVersion":"1.7","serialNumber":"urn:uuid:00000000-0000-4000-8000-@KEY@","version":1,'
_PART = '"type":"library","name":"n-@KEY@","version":"1"'
#: Documents by kind of defect: text, first rule that it breaks.
DEFECTS = (
    (_HEAD + '"components":[{' + _PART + "}]}", None),
    ('{"specVersion": broken @KEY@', "unreadable"),
    (_HEAD + '"components":[{"name":"n"}]}', "required"),
    (_HEAD + '"components":[{"type":"thing","name":"n"}]}', "enum"),
    (_HEAD + '"components":[{' + _PART + ',"bom-ref":""}]}', "length"),
    (_HEAD + '"components":[{' + _PART + ',"hashes":[{"alg":"MD5","content":"abc"}]}]}', "pattern"),
    (_HEAD + '"components":[{' + _PART + ',"licenses":[{"license":{"id":"MIT","name":"both"}}]}]}', "choice"),
    (_HEAD + '"components":[{' + _PART + ',"versionRange":"vers:generic/*","isExternal":true}]}', "version_range"),
    (_HEAD + '"components":[{' + _PART + ',"data":[{"type":"dataset"}]}]}', "type_specific"),
    (_HEAD + '"metadata":{"timestamp":"2024-01-01"}}', "timestamp"),
    (_HEAD + '"metadata":{"strange":1}}', "unknown_field"),
    (_HEAD + '"citations":[{"pointers":["/a"],"timestamp":"2024-01-01T00:00:00Z"}]}', "citation_source"),
    ('{"specVersion":"1.7","version":0}', "range"),
    ('{"specVersion":"1.10","version":1,"components":[{"type":"data","name":"n"}]}', None),
    ('{"specVersion":"1.3","version":1,"components":[{' + _PART + "},{" + _PART + "}]}", "unique_items"),
    (_HEAD + '"components":[{' + _PART + '}],"dependencies":[{"ref":"gone","dependsOn":["lost"]}]}', None),
    (_HEAD + '"components":[{"type":"cryptographic-asset","name":"n","cryptoProperties":{"assetType":"gizmo"}}]}', "enum"),
    (_HEAD + '"vulnerabilities":[{"id":"V-1","created":"banana"}]}', "timestamp"),
    (_HEAD + '"vulnerabilities":[{"id":"V-1","gizmo":1}]}', "unknown_field"),
    (_HEAD + '"compositions":[{"aggregate":"gizmo"}]}', "enum"),
    (_HEAD + '"dependencies":[{"ref":"a","gizmo":"b"}]}', "unknown_field"),
    (_HEAD + '"formulation":[{"workflows":[{"bom-ref":"w","uid":"w","tasks":[{"taskTypes":["build","gizmo"]}]}]}]}', "enum"),
    (_HEAD + '"components":[{' + _PART + ',"supplier":{"bom-ref":"s","name":"s"}}]}', None),
)


def defect_docs(t):
    """One document per order, its defect by order key."""
    k = F.col("o_orderkey")
    texts = F.array(*[F.lit(text) for text, _ in DEFECTS])
    text = F.get(texts, (k % len(DEFECTS)).cast("int"))
    return typed(t.raw("orders").select(k.alias("bom_id"), F.replace(text, F.lit("@KEY@"), F.lpad(k.cast("string"), 12, "0")).alias("content")))


_RULE = "CASE o_orderkey % " + str(len(DEFECTS)) + " " + " ".join(f"WHEN {i} THEN {'NULL' if r is None else repr(r)}" for i, (_, r) in enumerate(DEFECTS)) + " END"


@query("validate_documents", f"SELECT o_orderkey AS bom_id, {_RULE} IS NULL AS valid, {_RULE} AS first_rule FROM orders")
def _(t):
    docs = defect_docs(t)
    return R.document_verdict(docs, R.validate(docs)).select("bom_id", "valid", "first_rule")


@query(
    "verdicts_of_files",
    f"""SELECT o_orderkey AS bom_id, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'valid-' ELSE 'invalid-' END, CAST(o_orderkey AS VARCHAR), '.json') AS file, o_orderkey % 3 = 0 AS expected,
{_RULE} IS NULL AS valid, {_RULE} AS first_rule FROM orders WHERE (o_orderkey % 3 = 0) <> ({_RULE} IS NULL)""",
)
def _(t):
    k = F.col("bom_id")
    name = F.concat(F.lit("/corpus/"), F.when(k % 3 == 0, "valid-").otherwise("invalid-"), k.cast("string"), F.lit(".json"))
    docs = defect_docs(t).withColumn("source_path", name)
    return R.verdict_vs_expected(R.document_verdict(docs, R.validate(docs)), docs)
