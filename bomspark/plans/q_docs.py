"""Queries for readers and flattening operators, run over document corpora
derived from the tables; the check states the same rows over the tables."""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import scalars as S
from ..model import enums as en
from ..operators import aggs as A, flatten as X, graph as G, joins as J, windows as W
from ..session import kept
from ..sources.documents import typed
from . import corpus as C
from .registry import query

L = "lineitem"


def ntz(df: DataFrame) -> DataFrame:
    """Zone-less times, as the tables have them."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else df


def doc_query(name: str, sql: str | None = None, views: str = ""):
    def deco(fn):
        return query(name, sql, views)(lambda t: ntz(fn(t)))

    return deco


LINE = "CAST(substr(bom_ref, 3) AS INT)"
DEPTH = f"CASE WHEN {LINE} <= 3 THEN 0 WHEN {LINE} <= 5 THEN 1 ELSE 2 END"
ELEMENTS = f"""bundles AS (SELECT DISTINCT bom_id, 'b-1' AS bom_ref, 0 AS depth, CAST(NULL AS VARCHAR) AS parent_ref FROM component WHERE {LINE} >= 4
UNION ALL SELECT DISTINCT bom_id, 'b-2', 1, 'b-1' FROM component WHERE {LINE} >= 6)"""


@doc_query(
    "flatten_components",
    f"""{ELEMENTS}
SELECT bom_id, bom_ref, CAST({DEPTH} AS INT) AS depth, CASE {DEPTH} WHEN 1 THEN 'b-1' WHEN 2 THEN 'b-2' END AS parent_ref, 'inventory' AS role, type, name, version,
coalesce(scope, 'required') AS scope, is_external FROM component
UNION ALL SELECT bom_id, bom_ref, CAST(depth AS INT), parent_ref, 'inventory', 'container', 'bundle', NULL, 'required', false FROM bundles
UNION ALL SELECT o_orderkey, 'main', 0, NULL, 'main', 'application', concat('app-', CAST(o_orderkey AS VARCHAR)), NULL, 'required', false FROM orders""",
    "component",
)
def _(t):
    got = X.flatten_components(X.component_elements(C.component_docs(t), ("main", "inventory")))
    return got.select("bom_id", "bom_ref", "depth", "parent_ref", "role", "type", "name", "version", "scope", "is_external")


@doc_query(
    "apply_defaults",
    """SELECT c.bom_id, bom_ref, package_id, coalesce(scope, 'required') AS scope, is_external, version FROM
(SELECT bom_id, bom_ref, package_id, scope, is_external FROM component) c JOIN (SELECT bom_id, version FROM bom) b ON b.bom_id = c.bom_id""",
    "bom component",
)
def _(t):
    c = t.component.select(
        "bom_id", "bom_ref", "package_id", "scope", F.when(F.col("is_external"), F.lit(True)).alias("is_external")
    )
    b = t.bom.select("bom_id", F.when(F.col("version") > 1, F.col("version")).alias("version"))
    return X.apply_defaults(c.join(b, "bom_id"))


@doc_query(
    "bom_table",
    """SELECT bom_id, serial_number, version, spec_version, created_at, tlp, 'main' AS main_component_ref FROM bom""",
    "bom",
)
def _(t):
    return X.bom_table(C.component_docs(t))


@doc_query("lifecycle_table", "SELECT bom_id, lifecycle_phase AS phase FROM bom", "bom")
def _(t):
    return X.lifecycle_table(C.component_docs(t)).select("bom_id", "phase")


SVC = "s-', CAST(c_custkey AS VARCHAR))"


@doc_query(
    "flatten_services",
    f"""SELECT CAST(c_custkey // 8 AS BIGINT) AS bom_id, concat('{SVC} AS bom_ref, CAST(CASE WHEN c_custkey % 8 < 4 THEN 0 ELSE 1 END AS INT) AS depth,
CASE WHEN c_custkey % 8 >= 4 THEN concat('s-', CAST(c_custkey - 4 AS VARCHAR)) END AS parent_ref, concat('svc-', CAST(c_custkey AS VARCHAR)) AS name,
c_custkey % 2 = 0 AS authenticated, c_custkey % 3 = 0 AS x_trust_boundary, lower(c_mktsegment) AS trust_zone FROM customer""",
)
def _(t):
    got = X.flatten_services(X.service_elements(C.service_docs(t)))
    return got.select("bom_id", "bom_ref", "depth", "parent_ref", "name", "authenticated", "x_trust_boundary", "trust_zone")


FLOWS = """fl AS (SELECT CAST(c_custkey // 8 AS BIGINT) AS bom_id, concat('s-', CAST(c_custkey AS VARCHAR)) AS owner_ref, c_custkey AS k, c_mktsegment AS classification,
CASE c_custkey % 4 WHEN 0 THEN 'inbound' WHEN 1 THEN 'outbound' WHEN 2 THEN 'bi-directional' ELSE 'unknown' END AS direction FROM customer),
ends AS (SELECT *, concat('s-', CAST(k AS VARCHAR)) AS source, concat('s-', CAST(k + 1 AS VARCHAR)) AS destination FROM fl
UNION ALL SELECT *, concat('s-', CAST(k AS VARCHAR)), concat('x-', CAST(k AS VARCHAR)) FROM fl)"""


@doc_query("explode_data_flows", FLOWS + " SELECT bom_id, owner_ref, direction, classification, source, destination FROM ends")
def _(t):
    got = X.explode_data_flows(X.service_elements(C.service_docs(t)))
    return got.select("bom_id", "owner_ref", "direction", "classification", "source", "destination")


@doc_query(
    "flow_across_trust",
    FLOWS + """, z AS (SELECT CAST(c_custkey // 8 AS BIGINT) AS bom_id, concat('s-', CAST(c_custkey AS VARCHAR)) AS r, lower(c_mktsegment) AS zone, c_custkey % 3 = 0 AS x FROM customer)
SELECT e.bom_id, source, destination, direction, a.zone AS source_zone, b.zone AS destination_zone FROM ends e
LEFT JOIN z a ON a.bom_id = e.bom_id AND a.r = source LEFT JOIN z b ON b.bom_id = e.bom_id AND b.r = destination
WHERE coalesce(a.zone <> b.zone, false) OR coalesce(a.x, false) OR coalesce(b.x, false)""",
)
def _(t):
    sv = X.service_elements(C.service_docs(t))
    got = J.flow_across_trust(X.explode_data_flows(sv), X.flatten_services(sv))
    return got.select("bom_id", "source", "destination", "direction", "source_zone", "destination_zone")


@doc_query(
    "flow_matrix",
    "SELECT c_mktsegment AS classification, "
    + ", ".join(f"count(*) FILTER (c_custkey % 4 = {i}) AS {d.replace('-', '_')}" for i, d in enumerate(en.FLOW_DIRECTIONS))
    + " FROM customer GROUP BY 1",
)
def _(t):
    f = X.explode_data_flows(X.service_elements(C.service_docs(t)))
    return A.flow_matrix(f.select("bom_id", "owner_ref", "position", "direction", "classification").distinct())


@doc_query(
    "explode_dependencies",
    """SELECT bom_id, ref, 'dependsOn' AS kind, CASE WHEN ref <> 'c-7' THEN target END AS target, ref = 'c-7' AS declared_empty FROM doc_edge
UNION ALL SELECT bom_id, ref, 'provides', 'std-1', false FROM doc_edge WHERE ref = 'c-1'""",
    "doc_edge",
)
def _(t):
    return X.explode_dependencies(C.component_docs(t, deps=True))


@doc_query(
    "implementers_of",
    "SELECT bom_id, 'std-1' AS provided, bom_ref AS ref, name AS implementer FROM component WHERE bom_ref = 'c-1'",
    "component",
)
def _(t):
    docs = C.component_docs(t, deps=True)
    return J.implementers_of(X.explode_dependencies(docs), X.flatten_components(X.component_elements(docs, ("inventory",))))


def comps(t):
    return X.component_elements(C.component_docs(t), ("inventory",))


@doc_query("explode_hashes", "SELECT bom_id, bom_ref AS owner_ref, 'MD5' AS alg, hash_md5 AS value FROM component", "component")
def _(t):
    return X.explode_hashes(comps(t)).select("bom_id", "owner_ref", "alg", "value")


@doc_query(
    "explode_licenses",
    """SELECT bom_id, bom_ref AS owner_ref, CASE package_id % 3 WHEN 0 THEN 'expression' WHEN 1 THEN 'id' ELSE 'name' END AS kind,
CASE package_id % 3 WHEN 0 THEN concat('MIT OR ', license_id) WHEN 1 THEN license_id ELSE concat('Named ', license_id) END AS value,
CASE WHEN package_id % 3 <> 0 THEN 'declared' END AS acknowledgement, false AS observed FROM component""",
    "component",
)
def _(t):
    return X.explode_licenses(comps(t)).select("bom_id", "owner_ref", "kind", "value", "acknowledgement", "observed")


@doc_query(
    "explode_license_contracts",
    """SELECT bom_id, bom_ref AS owner_ref, license_id AS license, concat('S-', CAST(supplier_id AS VARCHAR)) AS licensee, concat('buyer-', CAST(package_id % 11 AS VARCHAR)) AS purchaser,
concat('PO-', CAST(package_id AS VARCHAR)) AS purchase_order, 'perpetual,oem' AS license_types, released_at AS expiration FROM component WHERE package_id % 6 = 1""",
    "component",
)
def _(t):
    got = X.explode_license_contracts(X.explode_licenses(comps(t), with_contracts=True))
    return got.select(
        "bom_id", "owner_ref", "license", "licensee", "purchaser", "purchase_order", F.array_join("license_types", ",").alias("license_types"), "expiration"
    )


@doc_query(
    "explode_external_references",
    """SELECT bom_id, bom_ref AS owner_ref, 0 AS position, 'website' AS type, concat('https://h', CAST(package_id % 13 AS VARCHAR), '.example/', CAST(package_id AS VARCHAR)) AS url FROM component
UNION ALL SELECT bom_id, bom_ref, 1, 'vcs', concat('git://v/', CAST(supplier_id AS VARCHAR)) FROM component""",
    "component",
)
def _(t):
    docs = C.component_docs(t)
    got = X.explode_external_references(docs, X.component_elements(docs, ("main", "inventory")), X.service_elements(docs))
    return got.select("bom_id", "owner_ref", "position", "type", "url")


PROPS = """props AS (SELECT bom_id, bom_ref AS owner_ref, package_id, 0 AS position, 'tier' AS name, CAST(supplier_id % 3 AS VARCHAR) AS value FROM component
UNION ALL SELECT bom_id, bom_ref, package_id, 1, 'tier', 'x' FROM component UNION ALL SELECT bom_id, bom_ref, package_id, 2, 'lot', CAST(package_id AS VARCHAR) FROM component)"""


@doc_query("explode_properties", PROPS + " SELECT bom_id, owner_ref, position, name, value FROM props", "component")
def _(t):
    docs = C.component_docs(t)
    got = X.explode_properties(docs, X.component_elements(docs, ("main", "inventory")), X.service_elements(docs))
    return got.select("bom_id", "owner_ref", "position", "name", "value")


@doc_query(
    "filter_by_property",
    "SELECT bom_id, bom_ref, name FROM component WHERE supplier_id % 3 = 2",
    "component",
)
def _(t):
    docs = C.component_docs(t)
    el = X.component_elements(docs, ("inventory",), taken=(*X.FLAT, "properties"))
    # owners and properties are two readings of one narrow frame
    flat = kept(X.flatten_components(el, ("properties",)).select("bom_id", "pointer", "bom_ref", "name", "properties"), "owners")
    props = X._props(flat, F.col("properties"), F.col("pointer"), F.col("bom_ref"))
    return J.filter_by_property(flat, props, "tier", "2%").select("bom_id", "bom_ref", "name")


@doc_query(
    "property_pivot",
    "SELECT bom_id, bom_ref AS owner_ref, concat(CAST(supplier_id % 3 AS VARCHAR), '|x') AS tier, CAST(package_id AS VARCHAR) AS lot FROM component",
    "component",
)
def _(t):
    el = comps(t)
    props = X._props(el, F.col("c.properties"), F.col("pointer"), F.col("c")["bom-ref"])
    got = A.property_pivot(props, ["tier", "lot"], with_refs=True)
    return got.filter("owner_ref NOT LIKE 'b-%'").select("bom_id", "owner_ref", "tier", "lot")


P = "CAST(package_id AS VARCHAR)"


@doc_query(
    "explode_identifiers",
    f"""SELECT bom_id, bom_ref AS owner_ref, 'purl' AS kind, purl AS value FROM component
UNION ALL SELECT bom_id, bom_ref, 'cpe', concat('cpe:2.3:a:acme:p', {P}, ':1.0:*:*:*:*:*:*:*') FROM component WHERE package_id % 5 = 0
UNION ALL SELECT bom_id, bom_ref, 'swid', concat('tag-', {P}) FROM component WHERE package_id % 10 = 0
UNION ALL SELECT bom_id, bom_ref, 'omnibor', concat('gitoid:blob:sha1:', {P}) FROM component WHERE package_id % 7 = 0
UNION ALL SELECT bom_id, bom_ref, 'omnibor', concat('gitoid:blob:sha256:', {P}) FROM component WHERE package_id % 7 = 0""",
    "component",
)
def _(t):
    return X.explode_identifiers(comps(t)).select("bom_id", "owner_ref", "kind", "value")


@doc_query(
    "swid_defaults",
    f"SELECT bom_id, bom_ref AS owner_ref, concat('tag-', {P}) AS tag_id, '0.0' AS version, 0 AS tag_version, false AS patch FROM component WHERE package_id % 10 = 0",
    "component",
)
def _(t):
    return X.swid_table(comps(t)).select("bom_id", "owner_ref", "tag_id", "version", "tag_version", "patch")


@doc_query(
    "explode_parties",
    """SELECT bom_id, 'supplier' AS role, 'organization' AS kind, concat('S-', CAST(supplier_id AS VARCHAR)) AS name, concat('C-', CAST(supplier_id % 25 AS VARCHAR)) AS country FROM component
UNION ALL SELECT bom_id, 'publisher', 'text', concat('P-', CAST(package_id % 7 AS VARCHAR)), NULL FROM component WHERE package_id % 4 = 0
UNION ALL SELECT o_orderkey, 'supplier', 'organization', concat('M-', CAST(o_orderkey % 9 AS VARCHAR)), NULL FROM orders""",
    "component",
)
def _(t):
    # three readings of the documents, made once
    docs = typed(kept(C.component_docs(t).select("bom_id", "content"), "party-documents"))
    got = X.explode_parties(docs, X.component_elements(docs, ("main", "inventory"), taken=X.PARTIES), X.service_elements(docs))
    return got.select("bom_id", "role", "kind", "name", "country")


@doc_query(
    "bom_ref_index",
    f"""{ELEMENTS} SELECT bom_id, bom_ref AS ref, 'component' AS element_type FROM component UNION ALL SELECT bom_id, bom_ref, 'component' FROM bundles
UNION ALL SELECT o_orderkey, 'main', 'component' FROM orders""",
    "component",
)
def _(t):
    docs = C.component_docs(t)
    got = X.bom_ref_index(docs, X.component_elements(docs, ("main", "inventory")), X.service_elements(docs))
    return got.select("bom_id", "ref", "element_type")


@doc_query(
    "ref_use_index",
    """SELECT bom_id, 'dependency.ref' AS field, ref AS target FROM doc_edge UNION ALL SELECT bom_id, 'dependency.dependsOn', target FROM doc_edge WHERE ref <> 'c-7'
UNION ALL SELECT bom_id, 'dependency.provides', 'std-1' FROM doc_edge WHERE ref = 'c-1'
UNION ALL SELECT bom_id, 'composition', bom_ref FROM component UNION ALL SELECT bom_id, 'composition', 'main' FROM component""",
    "component doc_edge",
)
def _(t):
    docs = C.component_docs(t, deps=True, comps=True)
    return X.ref_use_index(docs, X.component_elements(docs, ("main", "inventory"))).select("bom_id", "field", "target")


@doc_query(
    "field_projection",
    """SELECT bom_id, serial_number, version, tlp, lifecycle_phase AS phase FROM (SELECT bom_id, serial_number, version, CASE WHEN tlp <> 'CLEAR' THEN tlp END AS tlp, lifecycle_phase FROM bom) x""",
    "bom",
)
def _(t):
    from ..sources.documents import field_projection

    return field_projection(C.component_docs(t), {
        "serial_number": ("/serialNumber", "string"), "version": ("/version", "int"),
        "tlp": ("/metadata/distributionConstraints/tlp", "string"), "phase": ("/metadata/lifecycles/0/phase", "string"),
    })


@doc_query(
    "explode_compositions",
    """SELECT bom_id, CASE scope WHEN 'required' THEN 'complete' WHEN 'optional' THEN 'incomplete' ELSE 'not_specified' END AS aggregate, 'assembly' AS member_kind, bom_ref AS ref FROM component
UNION ALL SELECT bom_id, CASE scope WHEN 'required' THEN 'complete' WHEN 'optional' THEN 'incomplete' ELSE 'not_specified' END, 'dependency', 'main' FROM component""",
    "component",
)
def _(t):
    return X.explode_compositions(C.component_docs(t, comps=True)).select("bom_id", "aggregate", "member_kind", "ref")


@doc_query(
    "composition_completeness",
    f"""{ELEMENTS}, s AS (SELECT bom_id, bom_ref AS ref, CASE scope WHEN 'required' THEN 9 WHEN 'optional' THEN 2 ELSE 0 END AS r FROM component),
m AS (SELECT bom_id, ref, min(r) AS r FROM (SELECT * FROM s UNION ALL SELECT bom_id, 'main', r FROM s) x GROUP BY 1, 2),
e AS (SELECT DISTINCT bom_id, bom_ref AS ref FROM component UNION ALL SELECT bom_id, bom_ref FROM bundles UNION ALL SELECT o_orderkey, 'main' FROM orders)
SELECT e.bom_id, e.ref, CASE m.r WHEN 9 THEN 'complete' WHEN 2 THEN 'incomplete' ELSE 'not_specified' END AS aggregate FROM e LEFT JOIN m ON m.bom_id = e.bom_id AND m.ref = e.ref""",
    "component",
)
def _(t):
    docs = C.component_docs(t, comps=True)
    refs = X.component_elements(docs, ("main", "inventory")).select("bom_id", F.col("c")["bom-ref"].alias("ref"))
    return A.composition_completeness(refs, X.explode_compositions(docs))


@doc_query(
    "assembly_tree",
    f"""{ELEMENTS} SELECT bom_id, bom_ref, CASE {DEPTH} WHEN 0 THEN bom_ref WHEN 1 THEN concat('b-1>', bom_ref) ELSE concat('b-1>b-2>', bom_ref) END AS path, CAST({DEPTH} + 1 AS INT) AS level FROM component
UNION ALL SELECT bom_id, bom_ref, CASE depth WHEN 0 THEN 'b-1' ELSE 'b-1>b-2' END, CAST(depth + 1 AS INT) FROM bundles""",
    "component",
)
def _(t):
    el = X.component_elements(C.component_docs(t), ("inventory",), taken=X.FLAT)
    return X.assembly_tree(X.flatten_components(el)).select("bom_id", "bom_ref", "path", "level")


# ------------------------------------------------------------------ vulnerabilities

K = "CAST(vuln_key AS VARCHAR)"
VKEY = "CAST(vuln_key // 10 AS BIGINT) AS bom_id, CAST(vuln_key % 10 AS INT) AS position"
VULN_CHILD = {
    "vulnerability": (
        f"SELECT {VKEY}, concat('v-', {K}) AS bom_ref, id, source_name, date_trunc('second', published_at) AS published_at FROM vulnerability",
        ["bom_ref", "id", "source_name", "published_at"],
    ),
    "alias": (f"SELECT {VKEY}, concat('ALT-', {K}) AS alias, 'alt' AS source_name FROM vulnerability", ["alias", "source_name"]),
    "rating": (
        f"SELECT {VKEY}, 0 AS child_position, source_name, score, severity, 'CVSSv31' AS method FROM vulnerability "
        f"UNION ALL SELECT {VKEY}, 1, 'alt', NULL, severity, 'other' FROM vulnerability",
        ["child_position", "source_name", "score", "severity", "method"],
    ),
    "cwe": (f"SELECT {VKEY}, cwe FROM vulnerability UNION ALL SELECT {VKEY}, cwe + 1 FROM vulnerability", ["cwe"]),
    "advisory": (f"SELECT {VKEY}, concat('A', {K}) AS title, concat('https://adv.example/', {K}) AS url FROM vulnerability", ["title", "url"]),
    "affects": (
        f"SELECT {VKEY}, concat('pkg-', CAST(package_id AS VARCHAR)) AS ref, NULL AS version, vers_range, 'affected' AS status FROM vulnerability "
        f"UNION ALL SELECT {VKEY}, concat('pkg-', CAST(package_id AS VARCHAR)), concat(CAST(package_id % 9 AS VARCHAR), '.0.0'), NULL, 'unaffected' FROM vulnerability",
        ["ref", "version", "vers_range", "status"],
    ),
    "analysis": (
        f"SELECT {VKEY}, analysis_state AS state, CASE WHEN analysis_state = 'not_affected' AND vuln_key % 4 = 1 THEN 'code_not_present' END AS justification, "
        f"CASE WHEN vuln_key % 3 = 2 THEN 'update,rollback' END AS response FROM vulnerability",
        ["state", "justification", "response"],
    ),
    "credit": (
        f"SELECT {VKEY}, 'individual' AS kind, concat('finder-', CAST(vuln_key % 17 AS VARCHAR)) AS name FROM vulnerability WHERE vuln_key % 2 = 0",
        ["kind", "name"],
    ),
}


def _vuln_child(child, cols):
    def fn(t):
        df = X.explode_vulnerabilities(C.vulnerability_docs(t))[child]
        if child == "vulnerability":
            df = df.withColumn("published_at", F.date_trunc("second", "published_at"))
        if child == "analysis":
            df = df.withColumn("response", F.array_join("response", ","))
        return df.select("bom_id", "position", *cols)

    return fn


for _child, (_sql, _cols) in VULN_CHILD.items():
    _name = "explode_vulnerabilities" + ("" if _child == "vulnerability" else "_" + _child)
    doc_query(_name, _sql, "vulnerability")(_vuln_child(_child, _cols))


# ------------------------------------------------------------------ annotations, formulation

ANN = """a AS (SELECT conv_id AS bom_id, concat('c-', CAST(turn AS VARCHAR)) AS subject, role, conv_id, text FROM conversations
UNION ALL SELECT conv_id, 'main', role, conv_id, text FROM conversations)"""


@doc_query(
    "explode_annotations",
    ANN + """ SELECT bom_id, subject, CASE WHEN role = 'user' THEN 'individual' ELSE 'component' END AS annotator_kind,
CASE WHEN role = 'user' THEN concat('a-', CAST(conv_id AS VARCHAR)) ELSE 'bot' END AS annotator, TIMESTAMP '2024-05-01' AS annotated_at, text FROM a""",
)
def _(t):
    got = X.explode_annotations(C.annotation_docs(t))
    return got.select("bom_id", "subject", "annotator_kind", "annotator", "annotated_at", "text")


@doc_query(
    "annotations_for",
    ANN + " SELECT bom_id, subject, CASE WHEN subject = 'c-0' THEN 'component' END AS element_type, text FROM a",
)
def _(t):
    docs = C.annotation_docs(t)
    el = X.component_elements(docs, ("inventory",))
    refs = el.select("bom_id", F.col("c")["bom-ref"].alias("ref"), F.lit("component").alias("element_type")).distinct()
    return J.annotations_for(X.explode_annotations(docs), refs).select("bom_id", "subject", "element_type", "text")


TT = "['copy', 'clone', 'lint', 'scan', 'merge', 'build', 'test'][l_linenumber]"
T_REF = "concat('t-', CAST(l_linenumber AS VARCHAR))"
Q = "CAST(CAST(l_quantity AS INT) AS VARCHAR)"
OWN = f"l_orderkey AS bom_id, {T_REF} AS owner_ref"
FORM = {
    "task": (
        f"SELECT l_orderkey AS bom_id, 'wf-1' AS workflow_ref, {T_REF} AS bom_ref, concat(CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS uid, {TT} AS task_types, "
        f"l_shipdate AS time_start, l_shipdate + INTERVAL (CAST(l_quantity AS INT)) HOUR AS time_end FROM lineitem",
        ["bom_id", "workflow_ref", "bom_ref", "uid", "task_types", "time_start", "time_end"],
    ),
    "workflow": ("SELECT DISTINCT l_orderkey AS bom_id, 'wf-1' AS bom_ref, 'wf' AS uid, 'build' AS task_types FROM lineitem", ["bom_id", "bom_ref", "uid", "task_types"]),
    "task_edge": (
        "SELECT bom_id, 'wf-1' AS workflow_ref, replace(ref, 'c-', 't-') AS ref, replace(target, 'c-', 't-') AS target FROM doc_edge",
        ["bom_id", "workflow_ref", "ref", "target"],
    ),
    "step": (f"SELECT {OWN}, 's1' AS name FROM lineitem", ["bom_id", "owner_ref", "name"]),
    "command": (
        f"SELECT {OWN}, 0 AS position, concat('make ', CAST(l_linenumber AS VARCHAR)) AS executed FROM lineitem UNION ALL SELECT {OWN}, 1, 'true' FROM lineitem",
        ["bom_id", "owner_ref", "position", "executed"],
    ),
    "task_io": (
        f"SELECT {OWN}, 'input' AS direction, NULL AS type, concat('in-', CAST(l_partkey AS VARCHAR)) AS resource FROM lineitem "
        f"UNION ALL SELECT {OWN}, 'output', 'artifact', concat('out-', CAST(l_partkey AS VARCHAR)) FROM lineitem",
        ["bom_id", "owner_ref", "direction", "type", "resource"],
    ),
    "trigger": (
        f"SELECT {OWN}, 'g-1' AS bom_ref, 'api' AS type, l_shipdate AS activated_at, concat('e-', {Q}) AS event_uid FROM lineitem WHERE l_linenumber = 7",
        ["bom_id", "owner_ref", "bom_ref", "type", "activated_at", "event_uid"],
    ),
    "condition": (f"SELECT {OWN}, concat('q>', {Q}) AS expression FROM lineitem WHERE l_linenumber = 7", ["bom_id", "owner_ref", "expression"]),
    "workspace": (
        f"SELECT {OWN}, 'w-1' AS bom_ref, 'read-write' AS access_mode, 'block' AS volume_mode, concat({Q}, 'GB') AS size_allocated FROM lineitem WHERE l_linenumber = 1",
        ["bom_id", "owner_ref", "bom_ref", "access_mode", "volume_mode", "size_allocated"],
    ),
}


def _child(make, explode, child, cols, lists=()):
    def fn(t):
        docs = make(t)
        df = explode(docs)[child]
        for c in lists:
            if c in cols:
                df = df.withColumn(c, F.array_join(c, ","))
        return df.select(*cols)

    return fn


for _c, (_sql, _cols) in FORM.items():
    doc_query("explode_formulation" + ("" if _c == "task" else "_" + _c), _sql, "doc_edge" if _c == "task_edge" else "")(
        _child(C.formulation_docs, X.explode_formulation, _c, _cols, ("task_types",))
    )


@doc_query(
    "workflow_task_durations",
    f"""SELECT {TT} AS task_type, CAST(sum(CAST(l_quantity AS INT) * 3600) AS BIGINT) AS total_seconds, round(avg(CAST(l_quantity AS INT) * 3600), 6) AS mean_seconds, count(*) AS n
FROM lineitem GROUP BY 1""",
)
def _(t):
    tasks = X.explode_formulation(C.formulation_docs(t))["task"].withColumn("task_type", F.explode("task_types"))
    return A.workflow_durations(tasks, "task_type", "time_start", "time_end")


# ------------------------------------------------------------------ declarations, standards, patents

LN = "CAST(l_linenumber AS VARCHAR)"
DECL = {
    "attestation_map": (
        "SELECT l_orderkey AS bom_id, 'a-0' AS assessor, concat('r-', CAST(l_partkey AS VARCHAR)) AS requirement, l_discount * 10 AS conformance_score, l_tax * 10 AS confidence_score FROM lineitem",
        ["bom_id", "assessor", "requirement", "conformance_score", "confidence_score"],
    ),
    "map_claim": (
        f"SELECT l_orderkey AS bom_id, concat('r-', CAST(l_partkey AS VARCHAR)) AS requirement, l_returnflag = 'R' AS counter, concat('k-', {LN}) AS claim FROM lineitem",
        ["bom_id", "requirement", "counter", "claim"],
    ),
    "claim": (f"SELECT DISTINCT l_orderkey AS bom_id, concat('k-', {LN}) AS bom_ref, 'main' AS target, 'holds' AS predicate FROM lineitem", ["bom_id", "bom_ref", "target", "predicate"]),
    "claim_evidence": (
        f"SELECT DISTINCT l_orderkey AS bom_id, concat('k-', {LN}) AS claim, false AS counter, concat('e-', {LN}) AS evidence FROM lineitem",
        ["bom_id", "claim", "counter", "evidence"],
    ),
    "evidence": (
        f"SELECT DISTINCT l_orderkey AS bom_id, concat('e-', {LN}) AS bom_ref, concat('p', {LN}) AS property_name, TIMESTAMP '2024-01-01' + INTERVAL (l_linenumber) DAY AS expires_at, 'auditor' AS author FROM lineitem",
        ["bom_id", "bom_ref", "property_name", "expires_at", "author"],
    ),
    "assessor": (
        "SELECT DISTINCT l_orderkey AS bom_id, concat('a-', CAST(l_suppkey AS VARCHAR)) AS bom_ref, l_suppkey % 2 = 0 AS third_party, concat('S-', CAST(l_suppkey AS VARCHAR)) AS organization FROM lineitem",
        ["bom_id", "bom_ref", "third_party", "organization"],
    ),
    "affirmation": (
        "o AS (SELECT DISTINCT l_orderkey AS bom_id FROM lineitem) SELECT bom_id, 'I affirm' AS statement, 'CEO' AS signatory, 'chief' AS role FROM o UNION ALL SELECT bom_id, 'I affirm', 'CTO', 'tech' FROM o",
        ["bom_id", "statement", "signatory", "role"],
    ),
}
for _c, (_sql, _cols) in DECL.items():
    doc_query("explode_declarations" + ("" if _c == "attestation_map" else "_" + _c), _sql)(
        _child(C.declaration_docs, X.explode_declarations, _c, _cols)
    )

PK = "CAST(p_partkey AS VARCHAR)"
STD = {
    "requirement": (
        f"""SELECT CAST(p_partkey // 64 AS BIGINT) AS bom_id, concat('r-', {PK}) AS bom_ref, concat('R.', CAST(p_partkey % 64 AS VARCHAR)) AS identifier,
CASE WHEN p_partkey % 64 > 0 THEN concat('r-', CAST(p_partkey // 64 * 64 + (p_partkey % 64 - 1) // 2 AS VARCHAR)) END AS parent, concat('CRE:', {PK}, '-', CAST(p_partkey % 10 AS VARCHAR)) AS open_cre FROM part""",
        ["bom_id", "bom_ref", "identifier", "parent", "open_cre"],
    ),
    "level_requirement": (
        f"SELECT CAST(p_partkey // 64 AS BIGINT) AS bom_id, concat('l-', {PK}) AS level_ref, concat('L', CAST(p_partkey % 64 AS VARCHAR)) AS level, concat('r-', {PK}) AS requirement FROM part WHERE p_partkey % 2 = 0",
        ["bom_id", "level_ref", "level", "requirement"],
    ),
    "standard": ("SELECT DISTINCT CAST(p_partkey // 64 AS BIGINT) AS bom_id, 'std-1' AS bom_ref, 'STD' AS name, 'o' AS owner FROM part", ["bom_id", "bom_ref", "name", "owner"]),
}
for _c, (_sql, _cols) in STD.items():
    doc_query("explode_standards" + ("" if _c == "requirement" else "_" + _c), _sql)(
        _child(C.standard_docs, X.explode_standards, _c, _cols, ("open_cre",))
    )


def _patents(docs):
    return X.explode_patents(docs, X.component_elements(docs, ("inventory",)))


FAM = "concat('fam-', CAST(p_partkey // 10 AS VARCHAR))"
B50 = "CAST(p_partkey // 50 AS BIGINT) AS bom_id"
WHO = f"CASE p_partkey % 3 WHEN 0 THEN 'org-1' WHEN 1 THEN concat('Org ', {PK}) ELSE concat('Jo ', {PK}) END"
KIND = "CASE p_partkey % 3 WHEN 0 THEN 'ref' WHEN 1 THEN 'organization' ELSE 'individual' END"
PAT = {
    "patent": (
        f"SELECT {B50}, concat('p-', {PK}) AS ref, concat('US', {PK}) AS patent_number, CASE WHEN p_partkey % 2 = 0 THEN 'US' ELSE 'EP' END AS jurisdiction, "
        "CASE WHEN p_partkey % 3 = 0 THEN 'granted' ELSE 'pending' END AS legal_status, TIMESTAMP '2015-01-01' AS filed_at FROM part",
        ["bom_id", "ref", "patent_number", "jurisdiction", "legal_status", "filed_at"],
    ),
    "patent_family_member": (f"SELECT {B50}, {FAM} AS family_ref, concat('p-', {PK}) AS member FROM part", ["bom_id", "family_ref", "member"]),
    "patent_assertion": (
        f"SELECT {B50}, concat('c-', {PK}) AS owner_ref, 'ownership' AS assertion_type, {KIND} AS asserter_kind, {WHO} AS asserter, concat('p-', {PK}) AS target FROM part "
        f"UNION ALL SELECT {B50}, concat('c-', {PK}), 'ownership', {KIND}, {WHO}, {FAM} FROM part",
        ["bom_id", "owner_ref", "assertion_type", "asserter_kind", "asserter", "target"],
    ),
}
for _c, (_sql, _cols) in PAT.items():
    doc_query("explode_patents" + ("" if _c == "patent" else "_" + _c.removeprefix("patent_")), _sql)(_child(C.patent_docs, _patents, _c, _cols))


@doc_query(
    "patent_coverage",
    f"""SELECT {B50}, {WHO} AS asserter, concat('US', {PK}) AS patent_number, NULL AS via_family FROM part
UNION ALL SELECT CAST(a.p_partkey // 50 AS BIGINT), {WHO.replace('p_partkey', 'a.p_partkey')}, concat('US', CAST(b.p_partkey AS VARCHAR)), {FAM.replace('p_partkey', 'a.p_partkey')}
FROM part a JOIN part b ON a.p_partkey // 10 = b.p_partkey // 10""",
)
def _(t):
    d = _patents(C.patent_docs(t))
    got = J.patent_coverage(d["patent_assertion"], d["patent"], d["patent_family_member"])
    return got.select("bom_id", "asserter", "patent_number", "via_family")


# ------------------------------------------------------------------ crypto, models, data

OK = "CAST(o_orderkey AS VARCHAR)"
B10 = "CAST(o_orderkey // 10 AS BIGINT) AS bom_id"
CRY = {
    "crypto_algorithm": (
        f"SELECT {B10}, concat('alg-', {OK}) AS ref, CASE o_orderkey % 4 WHEN 0 THEN 'ae' WHEN 1 THEN 'hash' WHEN 2 THEN 'signature' ELSE 'kem' END AS primitive, "
        "concat('FAM-', CAST(o_orderkey % 6 AS VARCHAR)) AS family, CASE WHEN o_orderkey % 8 = 2 THEN 'new-curve' WHEN o_orderkey % 4 = 2 THEN 'old-curve' END AS curve, "
        "CASE WHEN o_orderkey % 4 = 0 THEN 'gcm' END AS mode, 128 AS classical_level, CAST(o_orderkey % 7 AS INT) AS nist_quantum_level FROM orders",
        ["bom_id", "ref", "primitive", "family", "curve", "mode", "classical_level", "nist_quantum_level"],
    ),
    "crypto_asset": (
        f"SELECT {B10}, concat('alg-', {OK}) AS ref, 'algorithm' AS asset_type FROM orders UNION ALL SELECT {B10}, concat('cert-', {OK}), 'certificate' FROM orders "
        f"UNION ALL SELECT {B10}, concat('key-', {OK}), 'related-crypto-material' FROM orders UNION ALL SELECT {B10}, concat('tls-', {OK}), 'protocol' FROM orders",
        ["bom_id", "ref", "asset_type"],
    ),
    "crypto_certificate": (
        f"SELECT {B10}, concat('cert-', {OK}) AS ref, concat('CN=', CAST(o_custkey AS VARCHAR)) AS subject_name, o_orderdate AS not_valid_before, o_orderdate + INTERVAL 365 DAY AS not_valid_after FROM orders",
        ["bom_id", "ref", "subject_name", "not_valid_before", "not_valid_after"],
    ),
    "crypto_cert_state": (
        f"SELECT {B10}, concat('cert-', {OK}) AS ref, 0 AS position, 'pre-activation' AS state FROM orders UNION ALL SELECT {B10}, concat('cert-', {OK}), 1, 'active' FROM orders "
        f"UNION ALL SELECT {B10}, concat('cert-', {OK}), 2, 'destroyed' FROM orders WHERE o_orderstatus = 'F'",
        ["bom_id", "ref", "position", "state"],
    ),
    "crypto_cert_extension": (f"SELECT {B10}, concat('cert-', {OK}) AS ref, true AS common, 'keyUsage' AS name, 'sign' AS value FROM orders", ["bom_id", "ref", "common", "name", "value"]),
    "crypto_material": (f"SELECT {B10}, concat('key-', {OK}) AS ref, 'public-key' AS type, 'active' AS state, CAST(2048 AS BIGINT) AS size, 'HSM' AS mechanism FROM orders", ["bom_id", "ref", "type", "state", "size", "mechanism"]),
    "crypto_protocol": (f"SELECT {B10}, concat('tls-', {OK}) AS ref, 'tls' AS type, '1.3' AS version FROM orders", ["bom_id", "ref", "type", "version"]),
    "crypto_cipher_suite": (
        f"SELECT {B10}, concat('tls-', {OK}) AS ref, concat('SUITE-', CAST(o_orderkey % 5 AS VARCHAR)) AS suite, concat('alg-', {OK}) AS algorithm FROM orders "
        f"UNION ALL SELECT {B10}, concat('tls-', {OK}), concat('SUITE-', CAST(o_orderkey % 5 AS VARCHAR)), 'alg-none' FROM orders",
        ["bom_id", "ref", "suite", "algorithm"],
    ),
    "crypto_transform": (f"SELECT {B10}, concat('tls-', {OK}) AS ref, 'encr' AS transform, 'AES' AS name, 256 AS key_length, concat('alg-', {OK}) AS algorithm FROM orders", ["bom_id", "ref", "transform", "name", "key_length", "algorithm"]),
}


def _crypto(docs):
    return X.explode_crypto(X.component_elements(docs, ("inventory",), taken=("bom-ref", "name", "cryptoProperties")))


for _c, (_sql, _cols) in CRY.items():
    doc_query("explode_crypto" + ("" if _c == "crypto_algorithm" else "_" + _c.removeprefix("crypto_")), _sql)(_child(C.crypto_docs, _crypto, _c, _cols))


def _rel(frm, relation, to, ft, tt):
    return f"SELECT {B10}, {frm} AS from_ref, '{relation}' AS relation, {to} AS target, '{ft}' AS from_type, {tt} AS target_type FROM orders"


@doc_query(
    "crypto_uses",
    " UNION ALL ".join([
        _rel(f"concat('cert-', {OK})", "signatureAlgorithm", f"concat('alg-', {OK})", "certificate", "'algorithm'"),
        _rel(f"concat('cert-', {OK})", "asset:publicKey", f"concat('key-', {OK})", "certificate", "'related-crypto-material'"),
        _rel(f"concat('key-', {OK})", "algorithm", f"concat('alg-', {OK})", "related-crypto-material", "'algorithm'"),
        _rel(f"concat('tls-', {OK})", "cipherSuite", f"concat('alg-', {OK})", "protocol", "'algorithm'"),
        _rel(f"concat('tls-', {OK})", "cipherSuite", "'alg-none'", "protocol", "NULL"),
    ]),
)
def _(t):
    d = _crypto(C.crypto_docs(t))
    return J.crypto_uses(d["crypto_relation"], d["crypto_asset"]).select("bom_id", "from_ref", "relation", "target", "from_type", "target_type")


@doc_query(
    "crypto_inventory",
    """f AS (SELECT o_orderkey AS k, 'generate' AS fn FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sign' ELSE 'digest' END FROM orders)
SELECT CASE k % 4 WHEN 0 THEN 'ae' WHEN 1 THEN 'hash' WHEN 2 THEN 'signature' ELSE 'kem' END AS primitive, concat('FAM-', CAST(k % 6 AS VARCHAR)) AS family,
CASE WHEN k % 4 = 0 THEN 'gcm' END AS mode, CAST(NULL AS VARCHAR) AS padding, fn AS function, count(*) AS n FROM f GROUP BY ALL""",
)
def _(t):
    return A.crypto_inventory(_crypto(C.crypto_docs(t))["crypto_algorithm"])


@doc_query(
    "cert_state_sequence",
    f"""SELECT {B10}, concat('cert-', {OK}) AS ref, 0 AS position, 'pre-activation' AS state, 'active' AS next_state, 0 AS skipped FROM orders
UNION ALL SELECT {B10}, concat('cert-', {OK}), 1, 'active', CASE WHEN o_orderstatus = 'F' THEN 'destroyed' END, CASE WHEN o_orderstatus = 'F' THEN 3 END FROM orders
UNION ALL SELECT {B10}, concat('cert-', {OK}), 2, 'destroyed', NULL, NULL FROM orders WHERE o_orderstatus = 'F'""",
)
def _(t):
    d = _crypto(C.crypto_docs(t))["crypto_cert_state"]
    return W.cert_state_sequence(d, en.CERT_STATES).select("bom_id", "ref", "position", "state", "next_state", "skipped")


B20 = "CAST(p_partkey // 20 AS BIGINT) AS bom_id"
MREF = f"concat('m-', {PK}) AS owner_ref"
EN = "en AS (SELECT model_id, activity, CAST(sum(CAST(kwh AS DECIMAL(20, 2))) AS DOUBLE) AS kwh FROM energy GROUP BY 1, 2)"
MB = "CAST(model_id // 20 AS BIGINT) AS bom_id, concat('m-', CAST(model_id AS VARCHAR)) AS owner_ref"
MOD = {
    "model_card": (f"SELECT {B20}, {MREF}, CASE WHEN p_partkey % 2 = 0 THEN 'supervised' ELSE 'unsupervised' END AS approach, p_type AS task FROM part", ["bom_id", "owner_ref", "approach", "task"]),
    "model_metric": (
        f"SELECT {B20}, {MREF}, 'accuracy' AS type, CASE WHEN p_partkey % 10 = 0 THEN 'n/a' ELSE CAST(p_size * 2 AS VARCHAR) END AS value, p_type AS slice, "
        "CAST(p_size AS VARCHAR) AS lower_bound, CAST(p_size + p_partkey % 3 AS VARCHAR) AS upper_bound FROM part",
        ["bom_id", "owner_ref", "type", "value", "slice", "lower_bound", "upper_bound"],
    ),
    "model_dataset": (f"SELECT {B20}, {MREF}, concat('ds-', {PK}) AS ref FROM part", ["bom_id", "owner_ref", "ref"]),
    "model_energy": (f"{EN} SELECT {MB}, activity, kwh, kwh / 4 AS co2_cost_t FROM en", ["bom_id", "owner_ref", "activity", "kwh", "co2_cost_t"]),
    "model_energy_provider": (
        f"{EN} SELECT {MB}, activity, CASE WHEN length(activity) % 2 = 0 THEN 'wind' ELSE 'coal' END AS energy_source, concat('Grid ', CAST(length(activity) AS VARCHAR)) AS organization, kwh AS provided_kwh FROM en",
        ["bom_id", "owner_ref", "activity", "energy_source", "organization", "provided_kwh"],
    ),
    "model_fairness": (f"SELECT {B20}, {MREF}, concat('g-', CAST(p_partkey % 5 AS VARCHAR)) AS group_at_risk, 'h' AS harms FROM part", ["bom_id", "owner_ref", "group_at_risk", "harms"]),
    "model_consideration": (f"SELECT {B20}, {MREF}, 'users' AS kind, concat('u-', CAST(p_partkey % 5 AS VARCHAR)) AS text FROM part", ["bom_id", "owner_ref", "kind", "text"]),
}


def _models(docs):
    return X.explode_model_cards(X.component_elements(docs, ("inventory",)))


for _c, (_sql, _cols) in MOD.items():
    doc_query("explode_model_cards" + ("" if _c == "model_card" else "_" + _c.removeprefix("model_")), _sql, "energy" if "energy" in _c else "")(
        _child(C.model_docs, _models, _c, _cols)
    )


@doc_query(
    "energy_mix",
    f"{EN} SELECT CASE WHEN length(activity) % 2 = 0 THEN 'wind' ELSE 'coal' END AS energy_source, count(*) AS n, round(sum(kwh), 3) AS provided_kwh FROM en GROUP BY 1",
    "energy",
)
def _(t):
    return A.energy_mix(_models(C.model_docs(t))["model_energy_provider"])


@doc_query(
    "model_metrics",
    """SELECT 'accuracy' AS type, p_type AS slice, count(*) AS n, count(*) FILTER (p_partkey % 10 <> 0) AS n_numeric, round(avg(p_size * 2) FILTER (p_partkey % 10 <> 0), 10) AS mean_value,
round(avg(p_partkey % 3), 10) AS mean_width FROM part GROUP BY 2""",
)
def _(t):
    return A.model_metrics(_models(C.model_docs(t))["model_metric"])


@doc_query(
    "explode_component_data",
    f"SELECT CAST(p_partkey // 25 AS BIGINT) AS bom_id, concat('d-', {PK}) AS owner_ref, 'configuration' AS type, concat('f', {PK}) AS name, p_type AS classification, concat('https://d/', {PK}) AS url FROM part",
)
def _(t):
    got = X.explode_component_data(X.component_elements(C.data_docs(t), ("inventory",)))
    return got.select("bom_id", "owner_ref", "type", "name", "classification", "url")


@doc_query(
    "explode_data_governance",
    f"""SELECT CAST(p_partkey // 25 AS BIGINT) AS bom_id, concat('d-', {PK}) AS owner_ref, 'custodian' AS role, concat('Org-', CAST(p_partkey % 10 AS VARCHAR)) AS party FROM part
UNION ALL SELECT CAST(p_partkey // 25 AS BIGINT), concat('d-', {PK}), 'owner', concat('Own-', CAST(p_partkey % 3 AS VARCHAR)) FROM part""",
)
def _(t):
    return X.explode_data_governance(X.component_elements(C.data_docs(t), ("inventory",))).select("bom_id", "owner_ref", "role", "party")


# ------------------------------------------------------------------ evidence, pedigree, notes, citations

TECH = "CASE l_returnflag WHEN 'A' THEN 'binary-analysis' WHEN 'N' THEN 'manifest-analysis' ELSE 'filename' END"
XREF = f"l_orderkey AS bom_id, concat('x-', {LN}) AS owner_ref"


def ev(t):
    return X.component_elements(C.evidence_docs(t), ("inventory",))


@doc_query(
    "explode_evidence",
    f"SELECT {XREF}, 'purl' AS field, l_discount * 10 AS confidence, concat('pkg:x/', CAST(l_partkey AS VARCHAR)) AS concluded_value, concat('tool-', CAST(l_suppkey % 3 AS VARCHAR)) AS tools FROM lineitem",
)
def _(t):
    got = X.evidence_identity(ev(t))
    return got.select("bom_id", "owner_ref", "field", "confidence", "concluded_value", F.array_join("tools", ",").alias("tools"))


@doc_query(
    "explode_evidence_methods",
    f"SELECT {XREF}, {TECH} AS technique, l_discount * 10 AS confidence FROM lineitem UNION ALL SELECT {XREF}, 'other', l_tax FROM lineitem",
)
def _(t):
    return X.evidence_methods(X.evidence_identity(ev(t))).select("bom_id", "owner_ref", "technique", "confidence")


@doc_query("explode_evidence_occurrences", f"SELECT {XREF}, concat('/lib/', CAST(l_partkey AS VARCHAR)) AS location, l_linenumber AS line FROM lineitem")
def _(t):
    return X.evidence_occurrences(ev(t)).select("bom_id", "owner_ref", "location", "line")


@doc_query("explode_evidence_frames", f"SELECT {XREF}, concat('m', {LN}) AS module, l_linenumber AS line FROM lineitem")
def _(t):
    return X.evidence_frames(ev(t)).select("bom_id", "owner_ref", "module", "line")


@doc_query("explode_evidence_copyright", f"SELECT {XREF}, concat('Copyright ', CAST(l_suppkey AS VARCHAR)) AS text FROM lineitem")
def _(t):
    return X.evidence_copyright(ev(t)).select("bom_id", "owner_ref", "text")


@doc_query("explode_observed_licenses", f"SELECT {XREF}, 'id' AS kind, 'MIT' AS value, true AS observed FROM lineitem")
def _(t):
    return X.explode_licenses(ev(t)).select("bom_id", "owner_ref", "kind", "value", "observed")


@doc_query(
    "evidence_tools",
    f"""SELECT {XREF}, concat('tool-', CAST(l_suppkey % 3 AS VARCHAR)) AS tool_ref, CASE l_suppkey % 3 WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' END AS tool_name FROM lineitem""",
)
def _(t):
    docs = C.evidence_docs(t)
    # identities are read twice and kept for it; what tools are called is read from their part of the document alone
    ident = kept(X.evidence_identity(X.component_elements(docs, ("inventory", "tool"), taken=("bom-ref", "evidence"))).select("bom_id", "owner_pointer", "owner_ref", "field", "tools"), "identities")
    named = X.flatten_components(X.component_elements(docs, ("tool",), taken=X.FLAT).filter("role = 'tool'"))
    own = ident.select("bom_id", "owner_pointer", "owner_ref").distinct()
    return J.evidence_tools(ident, named).join(own, ["bom_id", "owner_pointer"]).select("bom_id", "owner_ref", "tool_ref", "tool_name")


@doc_query(
    "identity_confidence",
    f"""m AS (SELECT l_partkey, {TECH} AS technique, l_discount * 10 AS confidence FROM lineitem UNION ALL SELECT l_partkey, 'other', l_tax FROM lineitem)
SELECT concat('n-', CAST(l_partkey AS VARCHAR)) AS name, arg_max(technique, {{'c': confidence, 't': technique}}) AS best_technique, max(confidence) AS best_confidence,
round(CAST(sum(CAST(confidence AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 10) AS mean_confidence FROM m GROUP BY 1""",
)
def _(t):
    el = ev(t)
    names = el.select("bom_id", F.col("pointer").alias("owner_pointer"), F.col("c.name").alias("name"))
    m = X.evidence_methods(X.evidence_identity(el)).join(names, ["bom_id", "owner_pointer"])
    return A.identity_confidence(m, ["name"])


@doc_query(
    "evidence_techniques",
    f"""m AS (SELECT {TECH} AS technique, l_discount * 10 AS confidence FROM lineitem UNION ALL SELECT 'other', l_tax FROM lineitem)
SELECT technique, count(*) AS n, round(CAST(sum(CAST(confidence AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 10) AS mean_confidence FROM m GROUP BY 1""",
)
def _(t):
    return A.evidence_techniques(X.evidence_methods(X.evidence_identity(ev(t))))


@doc_query(
    "best_identity",
    f"""x AS (SELECT l_orderkey, l_partkey, l_discount * 10 AS c, concat('pkg:x/', CAST(l_partkey AS VARCHAR)) AS v FROM lineitem)
SELECT bom_id, v AS concluded_value, c AS confidence FROM (SELECT l_orderkey AS bom_id, v, c, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, v DESC) AS rn FROM x) y WHERE rn = 1""",
)
def _(t):
    # one document as the unit: the surest conclusion among its components
    i = X.evidence_identity(ev(t)).withColumn("owner_pointer", F.lit(""))
    return W.best_identity(i.select("bom_id", "owner_pointer", "field", "confidence", "concluded_value")).select("bom_id", "concluded_value", "confidence")


EV10 = "CAST(event_id // 10 AS BIGINT) AS bom_id, concat('e-', CAST(event_id AS VARCHAR)) AS owner_ref"
EK = "CAST(event_id AS VARCHAR)"


def ped(t):
    return X.component_elements(C.pedigree_docs(t), ("inventory",))


@doc_query("explode_pedigree", f"SELECT {EV10}, md5({EK}) AS uid, concat('u-', CAST(user_id AS VARCHAR)) AS author, date_trunc('second', ts) AS authored_at FROM events")
def _(t):
    return X.pedigree_commits(ped(t)).select("bom_id", "owner_ref", "uid", "author", "authored_at")


@doc_query("explode_pedigree_patches", f"SELECT {EV10}, CASE WHEN event_id % 2 = 0 THEN 'backport' ELSE 'unofficial' END AS type, concat('https://p/', {EK}) AS diff_url FROM events")
def _(t):
    return X.pedigree_patches(ped(t)).select("bom_id", "owner_ref", "type", "diff_url")


@doc_query("explode_pedigree_issues", f"SELECT {EV10}, CASE WHEN event_id % 3 = 0 THEN 'security' ELSE 'defect' END AS type, concat('I-', {EK}) AS id FROM events")
def _(t):
    return X.pedigree_issues(X.pedigree_patches(ped(t))).select("bom_id", "owner_ref", "type", "id")


@doc_query(
    "pedigree_lineage",
    """lv AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth UNION ALL SELECT event_id, depth + 1 FROM lv JOIN events ON event_id // 2 = k AND event_id > 0)
SELECT concat('pkg:e/', CAST(k AS VARCHAR)) AS node, CAST(depth AS INT) AS depth FROM lv""",
)
def _(t):
    e = X.pedigree_relations(ped(t)).filter("src <> dst").select("src", "dst")
    return G.transitive_dependencies(e, G.graph_roots(e))


@doc_query("explode_release_notes", f"SELECT {EV10}, 'minor' AS type, concat('R', {EK}) AS title, date_trunc('second', ts) AS released_at, concat('al-', {EK}) AS aliases, event_type AS tags FROM events")
def _(t):
    n = X.release_notes(ped(t))
    return n.select("bom_id", "owner_ref", "type", "title", "released_at", F.array_join("aliases", ",").alias("aliases"), F.array_join("tags", ",").alias("tags"))


@doc_query("explode_release_note_texts", f"SELECT {EV10}, 0 AS position, 'en-US' AS locale, concat('note ', {EK}) AS text FROM events UNION ALL SELECT {EV10}, 1, 'fr', 'n' FROM events")
def _(t):
    return X.release_note_texts(X.release_notes(ped(t))).select("bom_id", "owner_ref", "position", "locale", "text")


CIT = f"""c AS (SELECT o_orderkey AS bom_id, 'x-1' AS bom_ref, 'pointer' AS target_kind, '/components/0/name' AS target, CASE WHEN o_orderkey % 3 <> 0 THEN concat('org-', CAST(o_orderkey % 4 AS VARCHAR)) END AS attributed_to,
CASE WHEN o_orderkey % 3 = 1 THEN 'p-1' END AS process, o_orderdate AS cited_at FROM orders),
cit AS (SELECT * FROM c UNION ALL SELECT bom_id, bom_ref, target_kind, '/components/9/name', attributed_to, process, cited_at FROM c
UNION ALL SELECT bom_id, 'x-2', 'expression', '$..name', NULL, 'p-2', cited_at FROM c)"""


@doc_query("explode_citations", CIT + " SELECT * FROM cit")
def _(t):
    return X.explode_citations(C.citation_docs(t)).select("bom_id", "bom_ref", "target_kind", "target", "attributed_to", "process", "cited_at")


@doc_query(
    "cited_fields",
    CIT + " SELECT bom_id, target, CASE WHEN target = '/components/0/name' THEN concat('n/', CAST(bom_id AS VARCHAR)) END AS cited_value, attributed_to FROM cit WHERE target_kind = 'pointer'",
)
def _(t):
    docs = C.citation_docs(t)
    return J.cited_fields(X.explode_citations(docs), X.pointer_table(docs)).select("bom_id", "target", "cited_value", "attributed_to")


@doc_query(
    "json_pointer_get",
    "SELECT o_orderkey AS bom_id, concat('n/', CAST(o_orderkey AS VARCHAR)) AS first_name, 'c-1' AS first_ref, CAST(NULL AS VARCHAR) AS absent FROM orders",
)
def _(t):
    v = C.citation_docs(t).select("bom_id", F.parse_json("content").alias("v"))
    return v.select(
        "bom_id", S.json_pointer_get("v", "/components/0/name").alias("first_name"), S.json_pointer_get("v", "/components/0/bom-ref").alias("first_ref"),
        S.json_pointer_get("v", "/components/7/name").alias("absent"),
    )
