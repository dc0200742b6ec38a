"""Queries for sources and sinks, scalar functions, migrations, text jobs and
the function surface."""

from pyspark.sql import functions as F

from ..functions import scalars as S, sqlfuncs, udx
from ..model import doc_schema as D, enums as en
from ..operators import aggs as A, flatten as X, migrate as M, text as T
from ..session import kept, scratch_path
from ..sources import documents as docs_io, licenses as lic_io, xml_docs as XD, xml_json as XJ
from . import corpus as C
from .q_docs import DEPTH, doc_query
from .registry import query

# ------------------------------------------------------------------ sources and sinks

CONTENT_OK = "SELECT o_orderkey AS k FROM orders"


def plain_documents(t):
    edges = t.doc_edge_by_document.select("bom_id", "ref", "target")
    return docs_io.bom_documents(t.bom, t.component_by_document, edges)


ROUND = """SELECT b.serial_number, b.version, c.bom_ref, c.type, c.name, c.version AS component_version, c.license_id, c.hash_md5, coalesce(c.scope, 'required') AS scope
FROM bom b JOIN component c ON c.bom_id = b.bom_id"""


def round_trip(t, docs):
    el = X.component_elements(docs, ("inventory",))
    c = F.col("c")
    b = X.bom_table(docs).select("bom_id", "serial_number", "version")
    got = el.select(
        "bom_id", c["bom-ref"].alias("bom_ref"), c["type"].alias("type"), c["name"].alias("name"), c["version"].alias("component_version"),
        c["licenses"][0]["license"]["id"].alias("license_id"), c["hashes"][0]["content"].alias("hash_md5"),
        F.coalesce(c["scope"], F.lit("required")).alias("scope"),
    )
    return b.join(got, "bom_id").drop("bom_id")


@doc_query("write_bom_json", ROUND, "bom component")
def _(t):
    out = scratch_path(t.spark, "write_bom_json")
    docs_io.write_bom_json(plain_documents(t), out)
    return round_trip(t, docs_io.read_bom_jsonl(t.spark, out))


@doc_query("read_bom_jsonl", "SELECT serial_number, version, spec_version, created_at, tlp FROM bom", "bom")
def _(t):
    out = scratch_path(t.spark, "read_bom_jsonl")
    docs_io.write_bom_json(plain_documents(t), out)
    return X.bom_table(docs_io.read_bom_jsonl(t.spark, out)).select("serial_number", "version", "spec_version", "created_at", "tlp")


@doc_query("read_bom_json", "SELECT CAST(min(o_orderkey) AS BIGINT) AS first_order, count(*) AS n_orders FROM orders GROUP BY o_orderkey // 4096")
def _(t):
    # one wholetext file per block of order keys: a document whose components are the orders
    k = F.col("o_orderkey")
    item = C.js(type=F.lit("file"), name=k.cast("string"))
    g = C.gather(C.items(t.raw("orders"), F.floor(k / 4096).cast("bigint"), "c", F.lpad(k.cast("string"), 15, "0"), item), ["c"])
    out = scratch_path(t.spark, "read_bom_json")
    docs = C.finish(g, ("components", C.arr("c")))
    docs.select("bom_id", "content").repartition("bom_id").write.partitionBy("bom_id").text(out)
    got = docs_io.read_bom_json(t.spark, out, glob="*.txt")
    names = F.transform("doc.components", lambda v: F.try_variant_get(v, "$.name", "bigint"))
    return got.filter("variant IS NOT NULL").select(F.array_min(names).alias("first_order"), F.size(names).cast("bigint").alias("n_orders"))


@doc_query(
    "detect_format",
    """SELECT o_orderkey AS bom_id, CASE o_orderkey % 3 WHEN 0 THEN 'xml' WHEN 1 THEN 'json' ELSE 'unknown' END AS format,
CASE WHEN o_orderkey % 3 < 2 THEN concat('1.', CAST(3 + o_orderkey % 5 AS VARCHAR)) END AS spec_version, '1.6' AS path_version,
o_orderkey % 3 = 2 OR o_orderkey % 5 = 3 AS agree, o_orderkey % 3 < 2 AS known FROM orders""",
)
def _(t):
    k = F.col("o_orderkey")
    v = F.concat(F.lit("1."), (3 + k % 5).cast("string"))
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<bom xmlns="http://example.org/schema/bom/'), v, F.lit('" version="1"/>'))
    json_ = F.concat(F.lit('{"specVersion":"'), v, F.lit('"}'))
    raw = t.raw("orders").select(
        F.concat(F.lit("/corpus/1.6/b-"), k.cast("string"), F.lit("-1.6.json")).alias("source_path"),
        F.when(k % 3 == 0, xml).when(k % 3 == 1, json_).otherwise("plain words").alias("content"),
    )
    got = docs_io.detect_format(raw)
    key = F.regexp_extract("source_path", r"b-(\d+)-", 1).cast("bigint")
    return got.select(key.alias("bom_id"), "format", "spec_version", "path_version", "agree", "known")


@doc_query("quarantine_corrupt", "SELECT bom_id, bom_id % 10 = 0 AS corrupt FROM bom", "bom")
def _(t):
    d = plain_documents(t)
    broken = F.when(F.col("bom_id") % 10 == 0, F.substring("content", 1, 40)).otherwise(F.col("content"))
    good, bad = docs_io.quarantine_corrupt(d.withColumn("content", broken))
    return good.select("bom_id", F.lit(False).alias("corrupt")).unionByName(bad.select("bom_id", F.lit(True).alias("corrupt")))


@doc_query("write_tables", "SELECT spec_version, count(*) AS n_boms, CAST(sum(version) AS BIGINT) AS versions FROM bom GROUP BY 1", "bom")
def _(t):
    out = scratch_path(t.spark, "write_tables")
    docs_io.write_tables({"bom": t.bom, "organization": t.organization}, out)
    # the partition column comes back typed as text by schema, not by guess
    back = t.spark.read.schema(t.bom.schema).parquet(f"{out}/bom")
    return back.groupBy("spec_version").agg(F.count("*").alias("n_boms"), F.sum("version").alias("versions"))


@doc_query(
    "read_license_list",
    """SELECT license_id, CAST(max(CAST(released_at AS DATE)) AS VARCHAR) AS name, count(DISTINCT CAST(released_at AS DATE)) AS n, 'license' AS kind FROM component GROUP BY 1""",
    "component",
)
def _(t):
    # one list file per license, an entry per release day: ids repeat and the last name wins
    days = t.component.select("license_id", F.date_format("released_at", "yyyy-MM-dd").alias("day")).distinct()
    entry = F.concat(
        F.lit('<xs:enumeration value="'), "license_id", F.lit('"><xs:annotation><xs:documentation>'), "day",
        F.lit("</xs:documentation></xs:annotation></xs:enumeration>"),
    )
    files = days.groupBy("license_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("body"))
    xml = F.concat(F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">'), "body", F.lit("</xs:schema>"))
    out = scratch_path(t.spark, "read_license_list")
    files.select(F.col("license_id").alias("file"), xml.alias("value")).write.partitionBy("file").text(out)
    got = lic_io.read_license_list(t.spark, f"{out}/*")
    n = lic_io._entries(t.spark, f"{out}/*", "enumeration").groupBy("license_id").agg(F.count("*").alias("n"))
    return got.join(n, "license_id").select("license_id", "name", "n", F.coalesce("kind", F.lit("license")).alias("kind"))


def xml_text(t):
    """XML documents over the component table, one per line; line numbers 4
    and up sit inside a bundle, so components nest."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cat = C.cat
    one = cat(
        '<component type="', F.col("type"), '" bom-ref="', F.col("bom_ref"), '"><name>', esc(F.col("name")), "</name><version>", F.col("version"),
        "</version>", F.when(F.col("scope").isNotNull(), cat("<scope>", F.col("scope"), "</scope>")).otherwise(""),
        '<hashes><hash alg="MD5">', F.col("hash_md5"), "</hash></hashes><licenses><license><id>", F.col("license_id"), "</id></license></licenses><purl>",
        F.col("purl"), "</purl>",
        F.when(F.col("package_id") % 9 == 0, cat(
            '<v:vulnerabilities><v:vulnerability ref="', F.col("bom_ref"), '"><v:id>CVE-', F.col("package_id"), '</v:id><v:source name="NVD"/><v:ratings><v:rating><v:score><v:base>',
            F.col("package_id") % 11, "</v:base></v:score><v:severity>High</v:severity><v:method>Open FAIR</v:method></v:rating></v:ratings><v:cwes><v:cwe>",
            F.col("package_id") % 7, "</v:cwe></v:cwes></v:vulnerability></v:vulnerabilities>")).otherwise(""),
        "</component>",
    )
    line = F.substring("bom_ref", 3, 9).cast("int")
    rows = C.items(t.component_by_document, F.col("bom_id"), F.when(line <= 3, "top").otherwise("deep"), F.concat_ws("/", "bom_ref", "package_id", "supplier_id"), one)
    e = t.doc_edge_by_document
    edge = cat('<dependency ref="', F.col("ref"), '"><dependency ref="', F.col("target"), '"/></dependency>')
    rows = rows.unionByName(C.items(e, F.col("bom_id"), "dep", F.col("ref"), edge))
    comp = cat('<composition><aggregate>complete</aggregate><assemblies><assembly ref="', F.col("ref"), '"/></assemblies></composition>')
    rows = rows.unionByName(C.items(e, F.col("bom_id"), "cmp", F.col("ref"), comp))
    g = C.gather(rows, ["top", "deep", "dep", "cmp"]).join(t.bom.select("bom_id", "serial_number", "version", "spec_version"), "bom_id")
    j = lambda c: F.array_join(c, "")
    bundle = F.when(F.size("deep") > 0, cat('<component type="container" bom-ref="b-1"><name>bundle</name><components>', j("deep"), "</components></component>")).otherwise("")
    return g.select(cat(
        '<bom xmlns="http://example.org/schema/bom/', F.col("spec_version"), '" xmlns:v="http://example.org/schema/ext/vulnerability/1.0" serialNumber="', F.col("serial_number"), '" version="', F.col("version"),
        '"><components>', j("top"), bundle, "</components><dependencies>", j("dep"), "</dependencies><compositions>", j("cmp"), "</compositions></bom>",
    ).alias("value"))


def xml_docs(t):
    out = scratch_path(t.spark, "xml")
    xml_text(t).write.option("compression", "gzip").text(out)
    return XD.read_bom_xml_lines(t.spark, out)


#: Members that hash and license tables take of elements.
TAKEN = ("bom-ref", "hashes", "licenses", "evidence")


def taken(el):
    return el.select("bom_id", "pointer", F.struct(*[F.col("c")[n].alias(n) for n in TAKEN]).alias("c"))


LINE = "CAST(substr(bom_ref, 3) AS INT)"
_XML_TABLES = """SELECT 'hash' AS kind, bom_ref AS ref, hash_md5 AS value, count(*) AS n FROM component GROUP BY ALL
UNION ALL SELECT 'license', bom_ref, license_id, count(*) FROM component GROUP BY ALL
UNION ALL SELECT 'dependency', ref, target, count(*) FROM doc_edge GROUP BY ALL UNION ALL SELECT 'assembly', ref, 'complete', count(*) FROM doc_edge GROUP BY ALL"""


@doc_query(
    "read_bom_xml",
    f"""x AS (SELECT b.serial_number, b.version AS bom_version, b.spec_version, c.bom_ref, type, name, c.version, coalesce(scope, 'required') AS scope, CASE WHEN {LINE} <= 3 THEN 0 ELSE 1 END AS depth
FROM bom b JOIN component c ON c.bom_id = b.bom_id)
SELECT * FROM x UNION ALL SELECT DISTINCT serial_number, bom_version, spec_version, 'b-1', 'container', 'bundle', NULL, 'required', 0 FROM x WHERE depth = 1""",
    "bom component",
)
def _(t):
    d = xml_docs(t)
    b = XD.xml_bom_table(d).select("bom_id", "serial_number", F.col("version").alias("bom_version"), "spec_version")
    c = X.flatten_components(XD.xml_component_elements(d)).select("bom_id", "bom_ref", "type", "name", "version", "scope", "depth")
    return b.join(c, "bom_id").drop("bom_id")


@doc_query(
    "read_bom_xml_tables",
    _XML_TABLES,
    "component doc_edge",
)
def _(t):
    d = xml_docs(t)
    el = kept(taken(XD.xml_component_elements(d)), "xml-elements")
    parts = [
        X.explode_hashes(el).select(F.lit("hash").alias("kind"), F.col("owner_ref").alias("ref"), "value"),
        X.explode_licenses(el).select(F.lit("license").alias("kind"), F.col("owner_ref").alias("ref"), "value"),
        XD.xml_dependencies(d).select(F.lit("dependency").alias("kind"), "ref", F.col("target").alias("value")),
        XD.xml_compositions(d).select(F.lit("assembly").alias("kind"), "ref", F.col("aggregate").alias("value")),
    ]
    return X._union(parts).groupBy("kind", "ref", "value").agg(F.count("*").alias("n"))


@doc_query("read_bom_xml_documents", _XML_TABLES, "component doc_edge")
def _(t):
    """The same tables by the JSON operators, over XML read as document frames."""
    out = scratch_path(t.spark, "xml-documents")
    xml_text(t).write.option("compression", "gzip").text(out)
    raw = t.spark.read.text(out).select(F.col("value").alias("source_path"), F.col("value").alias("content"))
    # converted once: all tables read the kept JSON texts, and two of them the members that they take of the elements
    d = docs_io.typed(kept(XJ.xml_documents(raw).select("bom_id", "content"), "xml-json"))
    el = kept(taken(X.component_elements(d, taken=TAKEN)), "xml-json-elements")
    parts = [
        X.explode_hashes(el).select(F.lit("hash").alias("kind"), F.col("owner_ref").alias("ref"), "value"),
        X.explode_licenses(el).select(F.lit("license").alias("kind"), F.col("owner_ref").alias("ref"), "value"),
        X.explode_dependencies(d).filter("target IS NOT NULL").select(F.lit("dependency").alias("kind"), "ref", F.col("target").alias("value")),
        X.explode_compositions(d).select(F.lit("assembly").alias("kind"), "ref", F.col("aggregate").alias("value")),
    ]
    return X._union(parts).groupBy("kind", "ref", "value").agg(F.count("*").alias("n"))


@doc_query(
    "explode_legacy_vulnerabilities",
    """SELECT bom_ref AS ref, concat('CVE-', CAST(package_id AS VARCHAR)) AS id, CAST(package_id % 11 AS DOUBLE) AS score, 'high' AS severity, 'other' AS method, count(*) AS n
FROM component WHERE package_id % 9 = 0 GROUP BY ALL""",
    "component",
)
def _(t):
    el = XD.xml_component_elements(xml_docs(t), keep_extensions=True)
    r = XD.explode_legacy_vulnerabilities(el)["rating"]
    return r.groupBy("ref", "id", "score", "severity", "method").agg(F.count("*").alias("n"))


@doc_query(
    "upgrade_extensions",
    """SELECT 'dependency_edge' AS tbl, count(*) AS n FROM doc_edge UNION ALL SELECT 'vuln_rating', count(*) FROM component WHERE package_id % 9 = 0
UNION ALL SELECT 'vuln_cwe', count(*) FROM component WHERE package_id % 9 = 0 UNION ALL SELECT 'vuln_affects', count(*) FROM component WHERE package_id % 9 = 0""",
    "component doc_edge",
)
def _(t):
    d = xml_docs(t)
    legacy = XD.explode_legacy_vulnerabilities(XD.xml_component_elements(d, keep_extensions=True))
    tables = M.upgrade_extensions(XD.xml_dependencies(d), legacy)
    keep = ("dependency_edge", "vuln_rating", "vuln_cwe", "vuln_affects")
    return X._union([tables[n].select(F.lit(n).alias("tbl")) for n in keep]).groupBy("tbl").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ scalar functions


@query(
    "enum_canonical",
    "SELECT type, scope, count(*) AS n FROM component GROUP BY 1, 2",
    "component",
)
def _(t):
    # half of the rows use the long spelling, the other half the short one
    up = lambda c: F.upper(F.replace(c, F.lit("-"), F.lit("_")))
    long_ = F.col("package_id") % 2 == 0
    ty = F.when(long_, F.concat(F.lit("CLASSIFICATION_"), up("type"))).otherwise(F.col("type"))
    sc = F.when(long_, F.concat(F.lit("SCOPE_"), F.coalesce(F.upper("scope"), F.lit("UNSPECIFIED")))).otherwise(F.col("scope"))
    return t.component.select(
        S.enum_canonical(ty, "component_type").alias("type"), S.enum_canonical(sc, "scope").alias("scope")
    ).groupBy("type", "scope").agg(F.count("*").alias("n"))


@query(
    "purl_parts",
    "SELECT bom_id, bom_ref, 'generic' AS ptype, comp_group AS namespace, name, version FROM component",
    "component",
)
def _(t):
    p = t.component.select("bom_id", "bom_ref", S.purl_parts("purl").alias("p"))
    return p.select("bom_id", "bom_ref", F.col("p.type").alias("ptype"), "p.namespace", "p.name", "p.version")


@query("purl_without_version", "SELECT split_part(purl, '@', 1) AS package, count(*) AS n FROM component GROUP BY 1", "component")
def _(t):
    return t.component.select(S.purl_without_version("purl").alias("package")).groupBy("package").agg(F.count("*").alias("n"))


@query(
    "cpe_parts",
    "SELECT p_partkey, replace(p_brand, '#', ':') AS vendor, p_type AS product, CAST(p_size AS VARCHAR) AS version, 'a' AS part FROM part",
)
def _(t):
    cpe = F.concat(F.lit("cpe:2.3:a:"), F.replace("p_brand", F.lit("#"), F.lit("\\:")), F.lit(":"), F.col("p_type"), F.lit(":"), F.col("p_size").cast("string"), F.lit(":*:*:*:*:*:*:*"))
    p = t.raw("part").select("p_partkey", S.cpe_parts(cpe).alias("c"))
    return p.select("p_partkey", F.replace("c.vendor", F.lit("\\:"), F.lit(":")).alias("vendor"), "c.product", "c.version", "c.part")


@query(
    "bom_link_parts",
    "SELECT from_bom, from_ref, substr(link, 9, 36) AS uuid, CAST(split_part(split_part(link, '/', 2), '#', 1) AS INT) AS version, split_part(link, '#', 2) AS ref FROM bom_link",
    "bom_link",
)
def _(t):
    p = t.bom_link.select("from_bom", "from_ref", S.bom_link_parts("link").alias("p"))
    return p.select("from_bom", "from_ref", "p.uuid", "p.version", "p.ref")


@query(
    "bom_link_make",
    "SELECT bom_id, concat('urn:cdx:', substr(serial_number, 10), '/', CAST(version AS VARCHAR)) AS link FROM bom",
    "bom",
)
def _(t):
    return t.bom.select("bom_id", S.bom_link_make("serial_number", "version").alias("link"))


@query(
    "vers_constraints",
    """SELECT vuln_key, 'generic' AS scheme, 2 AS n, concat('>=', CAST(vuln_key % 40 AS VARCHAR), '.0.0') AS lower, concat('<', CAST(vuln_key % 40 + 10 AS VARCHAR), '.0.0') AS upper FROM vulnerability""",
    "vulnerability",
)
def _(t):
    v = t.vulnerability.select("vuln_key", S.vers_constraints("vers_range").alias("v"))
    side = lambda i: F.concat(F.col("v.constraints")[i]["op"], F.col("v.constraints")[i]["version"])
    return v.select("vuln_key", "v.scheme", F.size("v.constraints").alias("n"), side(0).alias("lower"), side(1).alias("upper"))


@query(
    "version_key",
    "SELECT DISTINCT CAST(split_part(version, '.', 1) AS BIGINT) AS major, CAST(split_part(version, '.', 2) AS BIGINT) AS minor, version FROM component",
    "component",
)
def _(t):
    k = t.component.select("version").distinct().withColumn("k", S.version_key("version"))
    return k.select(F.col("k.n")[0]["digits"].cast("bigint").alias("major"), F.col("k.n")[1]["digits"].cast("bigint").alias("minor"), "version")


@query(
    "in_range",
    """SELECT vuln_key, cwe >= vuln_key % 40 AND cwe < vuln_key % 40 + 10 AS inside FROM vulnerability""",
    "vulnerability",
)
def _(t):
    version = F.concat(F.col("cwe").cast("string"), F.lit("."), (F.col("vuln_key") % 7).cast("string"))
    return t.vulnerability.select("vuln_key", S.in_range(version, "vers_range").alias("inside"))


@query(
    "severity_rank",
    "SELECT vuln_key, CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 5 END AS rank FROM vulnerability",
    "vulnerability",
)
def _(t):
    return t.vulnerability.select("vuln_key", S.severity_rank("severity").alias("rank"))


@query(
    "tlp_rank",
    "SELECT bom_id, CASE tlp WHEN 'CLEAR' THEN 0 WHEN 'GREEN' THEN 1 WHEN 'AMBER' THEN 2 WHEN 'AMBER_AND_STRICT' THEN 3 ELSE 4 END AS rank FROM bom",
    "bom",
)
def _(t):
    return t.bom.select("bom_id", S.tlp_rank("tlp").alias("rank"))


@query(
    "aggregate_rank",
    "SELECT bom_id, bom_ref, CASE scope WHEN 'required' THEN 9 WHEN 'optional' THEN 2 ELSE 0 END AS rank FROM component",
    "component",
)
def _(t):
    agg = F.when(F.col("scope") == "required", "complete").when(F.col("scope") == "optional", "incomplete").otherwise("not_specified")
    return t.component.select("bom_id", "bom_ref", S.aggregate_rank(agg).alias("rank"))


@query("proto_ts", "SELECT event_id, ts FROM events")
def _(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.raw("events").select("event_id", F.floor(micros / 1_000_000).cast("bigint").alias("s"), ((micros % 1_000_000) * 1000 + 999).alias("n"))
    return e.select("event_id", S.proto_ts("s", "n").cast("timestamp_ntz").alias("ts"))


@query("norm_hash", "SELECT bom_id, bom_ref, hash_md5 AS value, 32 AS digits FROM component", "component")
def _(t):
    h = t.component.select("bom_id", "bom_ref", S.norm_hash(F.concat(F.lit(" "), F.upper("hash_md5"))).alias("h"))
    return h.select("bom_id", "bom_ref", "h.value", "h.digits")


@query("serial_uuid", "SELECT bom_id, substr(serial_number, 10) AS uuid FROM bom", "bom")
def _(t):
    braced = F.concat(F.lit("{"), F.substring("serial_number", 10, 36), F.lit("}"))
    return t.bom.select("bom_id", S.serial_uuid(F.when(F.col("bom_id") % 2 == 0, braced).otherwise(F.col("serial_number"))).alias("uuid"))


@query(
    "license_tokens",
    "SELECT bom_id, bom_ref, concat('MIT,LicenseRef-', CAST(package_id AS VARCHAR), ',Classpath-exception-2.0') AS tokens FROM component",
    "component",
)
def _(t):
    e = F.concat(F.lit("(MIT OR LicenseRef-"), F.col("package_id").cast("string"), F.lit(" WITH Classpath-exception-2.0) AND MIT"))
    return t.component.select("bom_id", "bom_ref", F.array_join(S.license_tokens(e), ",").alias("tokens"))


@query(
    "gitoid_parts",
    "SELECT bom_id, bom_ref, 'blob' AS object_type, 'sha1' AS hash_alg, hash_md5 AS digest, 'cnt' AS swh_type FROM component",
    "component",
)
def _(t):
    g = S.gitoid_parts(F.concat(F.lit("gitoid:blob:sha1:"), F.col("hash_md5")))
    w = S.swhid_parts(F.concat(F.lit("swh:1:cnt:"), F.col("hash_md5"), F.lit(";origin=x")))
    c = t.component.select("bom_id", "bom_ref", g.alias("g"), w.alias("w"))
    return c.select("bom_id", "bom_ref", "g.object_type", "g.hash_alg", F.col("w.digest").alias("digest"), F.col("w.object_type").alias("swh_type"))


@query(
    "net_co2",
    "SELECT model_id, activity, round(co2_cost_t - CASE WHEN model_id % 4 = 0 THEN 0 ELSE co2_offset_t END, 6) AS net FROM energy",
    "energy",
)
def _(t):
    off = F.when(F.col("model_id") % 4 != 0, F.col("co2_offset_t"))
    return t.energy.select("model_id", "activity", F.round(S.net_co2("co2_cost_t", off), 6).alias("net"))


@query(
    "cert_state_at",
    """SELECT cert_id, CASE WHEN cert_id % 11 = 0 AND not_valid_before + INTERVAL 100 DAY <= TIMESTAMP '1998-07-01' THEN 'revoked' WHEN TIMESTAMP '1998-07-01' < not_valid_before THEN 'pre-activation'
WHEN TIMESTAMP '1998-07-01' > not_valid_after THEN 'deactivated' ELSE 'active' END AS state_at FROM certificate""",
    "certificate",
)
def _(t):
    at = F.lit("1998-07-01").cast("timestamp_ntz")
    revoked = F.when(F.col("cert_id") % 11 == 0, F.col("not_valid_before") + F.expr("INTERVAL '100' DAY"))
    return t.certificate.select("cert_id", S.cert_state_at(at, "not_valid_before", "not_valid_after", revoked=revoked).alias("state_at"))


@query("content_hash", """SELECT bom_id, sha256(concat('{"serial_number":"', serial_number, '","version":', CAST(version AS VARCHAR), '}')) AS digest FROM bom""", "bom")
def _(t):
    return t.bom.select("bom_id", S.content_hash("version", "serial_number").alias("digest"))


# ------------------------------------------------------------------ migrations


@doc_query(
    "upgrade_tools",
    "SELECT o_orderkey AS bom_id, concat('V', CAST(o_custkey % 5 AS VARCHAR)) AS supplier, concat('T', CAST(o_custkey AS VARCHAR)) AS name, '1.10' AS version FROM orders",
)
def _(t):
    tool = C.S(vendor=C.cat("V", F.col("o_custkey") % 5), name=C.cat("T", F.col("o_custkey")), version=F.lit("1.10"))
    old = t.raw("orders").select(F.col("o_orderkey").alias("bom_id"), C.js(metadata=C.S(tools=F.array(tool))).alias("content"))
    new = M.upgrade_tools(docs_io.typed(old))
    got = X.flatten_components(X.component_elements(new, ("tool",)))
    return got.select("bom_id", "supplier", "name", "version")


@doc_query(
    "upgrade_data_flow",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS flow, c_mktsegment AS classification FROM customer",
)
def _(t):
    rec = F.array(F.struct(F.when(F.col("c_custkey") % 2 == 0, "inbound").otherwise("outbound").alias("flow"), F.col("c_mktsegment").alias("value")))
    new = M.upgrade_data_flow(t.raw("customer").select("c_custkey", rec.alias("data")))
    return new.select("c_custkey", F.explode("data").alias("d")).select("c_custkey", "d.flow", "d.classification")


@doc_query(
    "upgrade_cardinality",
    """SELECT p_partkey, concat('ev-', CAST(p_partkey AS VARCHAR)) AS evidence, concat('first,', CAST(p_partkey AS VARCHAR), ',second') AS copyright,
'b' AS tag, 'c' AS more_tags, 1 AS n_licenses, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS n_data FROM part""",
)
def _(t):
    k = F.col("p_partkey")
    old = t.raw("part").select(
        "p_partkey", 
        F.array(
            C.S(name=F.lit(None).cast("string"), copyright=F.array(F.lit("first"), k.cast("string"))), C.S(name=C.cat("ev-", k), copyright=F.array(F.lit("second")))
        ).alias("evidence"), F.array(F.lit("b"), F.lit("c")).alias("tag"),
        F.lit("MIT").alias("licenses"), F.when(k % 3 != 0, F.lit("d")).alias("data")
    )
    new = M.upgrade_cardinality(old, to_one=("evidence", "tag"), to_list=("licenses", "data"))
    return new.select("p_partkey", F.col("evidence.name").alias("evidence"), F.array_join("evidence.copyright", ",").alias("copyright"), "tag", F.array_join("tag_more", ",").alias("more_tags"), F.size("licenses").alias("n_licenses"), F.coalesce(F.size("data"), F.lit(-1)).alias("n_data"))


@doc_query(
    "upgrade_author",
    """SELECT o_orderkey AS bom_id, concat('A', CAST(o_custkey AS VARCHAR)) AS author, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE concat('M', CAST(o_custkey AS VARCHAR)) END AS manufacturer FROM orders""",
)
def _(t):
    cust = F.col("o_custkey")
    comp = F.array(C.S(type=F.lit("library"), name=F.lit("n"), author=C.cat("A", cust)))
    meta = C.S(manufacture=C.S(name=C.cat("M", cust)), manufacturer=F.when(F.col("o_orderkey") % 2 == 0, C.S(name=F.lit("new"))))
    old = docs_io.typed(t.raw("orders").select(F.col("o_orderkey").alias("bom_id"), C.js(metadata=meta, components=comp).alias("content")))
    el = M.upgrade_author(X.component_elements(old, ("inventory",)))
    new = M.upgrade_manufacture(old).select("bom_id", F.col("doc.metadata.manufacturer.name").alias("manufacturer"))
    return el.select("bom_id", F.col("c.authors")[0]["name"].alias("author")).join(new, "bom_id")


@doc_query(
    "upgrade_crypto",
    """k AS (SELECT CAST(o_orderkey // 10 AS BIGINT) AS bom_id, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s FROM orders)
SELECT bom_id, concat('alg-', s) AS ref, CASE WHEN k % 8 = 2 THEN 'new-curve' WHEN k % 4 = 2 THEN 'old-curve' END AS curve, NULL AS assets FROM k
UNION ALL SELECT bom_id, concat('cert-', s), NULL, concat('publicKey=key-', s, ',algorithm=alg-', s) FROM k
UNION ALL SELECT bom_id, concat('key-', s), NULL, concat('algorithm=alg-', s) FROM k""",
)
def _(t):
    k = M.upgrade_crypto(X.crypto_assets(X.component_elements(C.crypto_docs(t), ("inventory",))))
    p = F.col("p")
    assets = F.coalesce(p["certificateProperties"]["relatedCryptographicAssets"], p["relatedCryptoMaterialProperties"]["relatedCryptographicAssets"])
    text = F.array_join(F.transform(assets, lambda a: F.concat_ws("=", a["type"], a["ref"])), ",")
    return k.filter(p["assetType"] != "protocol").select("bom_id", "ref", p["algorithmProperties"]["ellipticCurve"].alias("curve"), text.alias("assets"))


# ------------------------------------------------------------------ text

WORDS = " UNION ALL ".join(
    f"SELECT doc_id, '{i}' AS license_id FROM documents WHERE contains(text, '{w}')"
    for i, w in (("Apache-2.0", "Apache License, Version 2.0"), ("MIT", "MIT License"), ("GPL-3.0-only", "GNU General Public License, version 3"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"))
)


@query("observe_licenses", WORDS)
def _(t):
    return T.observe_licenses(t.raw("documents"))


# Ids and names of a license list, and the phrases that texts may use for them.
LISTED = [
    ("Apache-2.0", "Apache License 2.0"), ("MIT", "MIT License"), ("GPL-3.0-only", "GNU General Public License v3.0 only"),
    ("GPL-3.0-or-later", "GNU General Public License v3.0 or later"), ("CC-BY-NC-4.0", "Creative Commons Attribution Non Commercial 4.0 International"),
    ("ISC", "ISC License"),
]
SPOKEN = [
    ("Apache-2.0", "apache license 2 0|apache 2 0|apache license 2|apache 2|apachev2|apache2"), ("MIT", "mit license|license mit|identifier mit|expat license"),
    ("GPL-3.0-only", "gnu general public license 3 0 only|gnu general public license 3 0|gnu general public license 3|gpl 3 0 only|gpl 3 0|gpl 3|gplv3|gpl3"),
    ("GPL-3.0-or-later", "gnu general public license 3 0 or later|gnu general public license 3 or later|gpl 3 0 or later|gpl 3 or later"),
    ("CC-BY-NC-4.0", "creative commons attribution non commercial 4 0 international|cc by nc 4 0|cc by nc 4"), ("ISC", "isc license|license isc|identifier isc"),
    ("BSD", "bsd license|bsd style license"), ("BSD-2-Clause", "simplified bsd license"), ("BSD-3-Clause", "new bsd license|modified bsd license"),
]
# no phrase begins where another does without being its prefix, so the longer one has to be looked for first
SPOKEN_SQL = (
    r"""n AS (SELECT doc_id, concat(' ', array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'version', 'v')),
lambda w: CASE WHEN w = 'licence' THEN 'license' WHEN regexp_full_match(w, 'v[0-9]+') THEN substr(w, 2) ELSE w END), ' '), ' ') AS t FROM documents), """
    "g AS (SELECT doc_id, t, regexp_replace(t, ' (gnu general public license|gpl) 3( 0)? or later ', ' GPLLATER ', 'g') AS u FROM n), "
    "f AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{i}' AS license_id FROM g WHERE " + ("contains(u, 'GPLLATER')" if i.endswith("later") else f"regexp_matches(u, ' ({alternatives}) ')")
        for i, alternatives in SPOKEN
    )
    + ") SELECT DISTINCT doc_id, license_id FROM f"
)


@query("observe_listed_licenses", SPOKEN_SQL)
def _(t):
    return T.observe_listed_licenses(t.raw("documents"), t.spark.createDataFrame(LISTED, "license_id string, name string"))


@query(
    "extract_copyright",
    r"""x AS (SELECT doc_id, unnest(regexp_extract_all(concat(text, chr(10), 'Copyright (c) 2024 ', source, chr(10), '© ', lang), '(?i)((?:copyright|\(c\)|©)[^\n]*)', 1)) AS s FROM documents) SELECT doc_id, trim(s) AS statement FROM x""",
)
def _(t):
    # the texts have no notice of their own: two lines are added to each
    notice = F.concat("text", F.lit("\nCopyright (c) 2024 "), "source", F.lit("\n© "), "lang")
    return T.extract_copyright(t.raw("documents").select("doc_id", notice.alias("text"))).select("doc_id", "statement")


@query(
    "decode_attachments",
    """SELECT doc_id, lang AS content_type, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 20 ELSE strlen(text) END AS n_bytes,
CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE md5(text) END AS digest, doc_id % 11 <> 0 AS valid FROM documents""",
)
def _(t):
    # every seventh attachment is an image's bytes, every eleventh is broken
    k = F.col("doc_id")
    binary = F.unhex(F.concat(F.lit("FFD8FFE0"), F.substring(F.sha2(k.cast("string"), 256), 1, 32)))
    text = F.when(k % 11 == 0, F.lit("not*base64")).when(k % 7 == 0, F.base64(binary)).otherwise(F.base64(F.encode("text", "UTF-8")))
    a = t.raw("documents").select("doc_id", F.col("lang").alias("content_type"), F.lit("base64").alias("encoding"), text.alias("content"))
    return T.decode_attachments(a).select("doc_id", "content_type", F.col("n_bytes").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"), "valid")


@query(
    "extract_urls",
    r"""SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1, 2""",
)
def _(t):
    return T.extract_urls(t.external_reference)


# ------------------------------------------------------------------ function surface


@query(
    "register_functions",
    """SELECT c.bom_id, bom_ref, split_part(purl, '@', 1) AS package, concat('urn:cdx:', substr(serial_number, 10), '/', CAST(b.version AS VARCHAR), '#', bom_ref) AS link,
CASE tlp WHEN 'CLEAR' THEN 0 WHEN 'GREEN' THEN 1 WHEN 'AMBER' THEN 2 WHEN 'AMBER_AND_STRICT' THEN 3 ELSE 4 END AS rank FROM component c JOIN bom b ON b.bom_id = c.bom_id""",
    "bom component",
)
def _(t):
    sqlfuncs.register_functions(t.spark)
    c = t.component.select("bom_id", "bom_ref", "purl").join(t.bom.select("bom_id", "serial_number", "version", "tlp"), "bom_id")
    return c.selectExpr(
        "bom_id", "bom_ref", "purl_without_version(purl) AS package", "bom_link_make(serial_number, version, bom_ref) AS link", "tlp_rank(tlp) AS rank"
    )


def _calendar(version: str):
    parts = version.split(".")
    return ([int(parts[0]), int(parts[2])], [parts[1]]) if len(parts) == 3 and all(p.isdigit() for p in parts) else None


@query(
    "version_key_scheme",
    "SELECT DISTINCT version, CAST(split_part(version, '.', 1) AS BIGINT) AS first, CAST(split_part(version, '.', 3) AS BIGINT) AS second FROM component",
    "component",
)
def _(t):
    udx.register_scheme("calendar", _calendar)
    key = udx.version_key_scheme("calendar")
    v = t.component.select("version").distinct().withColumn("k", key("version"))
    return v.select("version", F.col("k.n")[0]["digits"].cast("bigint").alias("first"), F.col("k.n")[1]["digits"].cast("bigint").alias("second"))


@query(
    "walk_document",
    """SELECT o_orderkey AS bom_id, '/components/0/name' AS pointer, 'name' AS key, concat('n/', CAST(o_orderkey AS VARCHAR)) AS value FROM orders
UNION ALL SELECT o_orderkey, '/components/0/bom-ref', 'bom-ref', 'c-1' FROM orders UNION ALL SELECT o_orderkey, '/components/0/type', 'type', 'library' FROM orders""",
)
def _(t):
    udx.register_table_functions(t.spark)
    C.citation_docs(t).select("bom_id", "content").createOrReplaceTempView("_bomspark_walk")
    return t.spark.sql(
        "SELECT d.bom_id, w.pointer, w.key, w.value FROM _bomspark_walk d, LATERAL walk_document(d.content) w WHERE w.pointer LIKE '/components/0/%'"
    )


@query(
    "pointer_table",
    """SELECT o_orderkey AS bom_id, '/components/0/name' AS pointer, 'scalar' AS kind, concat('n/', CAST(o_orderkey AS VARCHAR)) AS value FROM orders
UNION ALL SELECT o_orderkey, '/components/0', 'object', NULL FROM orders UNION ALL SELECT o_orderkey, '/components', 'array', NULL FROM orders
UNION ALL SELECT o_orderkey, '/components/0/bom-ref', 'scalar', 'c-1' FROM orders UNION ALL SELECT o_orderkey, '/components/0/type', 'scalar', 'library' FROM orders""",
)
def _(t):
    return X.pointer_table(C.citation_docs(t)).filter("pointer LIKE '/components%'").select("bom_id", "pointer", "kind", "value")
