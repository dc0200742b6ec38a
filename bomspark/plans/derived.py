"""The bill-of-materials tables laid over the driver's parquet tables, as
DataFrames and (for the check) as the same views in portable SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

VIEW_SQL = {
    "bom": """SELECT o_orderkey AS bom_id,
       printf('urn:uuid:%08x-0000-4000-8000-%012x', o_custkey, o_custkey) AS serial_number,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version,
       concat('1.', CAST(3 + o_orderkey % 5 AS VARCHAR)) AS spec_version, o_orderdate AS created_at,
       CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'CLEAR' WHEN '4' THEN 'GREEN' WHEN '3' THEN 'AMBER'
            WHEN '2' THEN 'AMBER_AND_STRICT' ELSE 'RED' END AS tlp,
       CASE o_orderstatus WHEN 'P' THEN 'pre-build' WHEN 'O' THEN 'build' ELSE 'operations' END AS lifecycle_phase
FROM orders""",
    "component": """SELECT l_orderkey AS bom_id, concat('c-', CAST(l_linenumber AS VARCHAR)) AS bom_ref,
       CASE p_type WHEN 'STANDARD' THEN 'library' WHEN 'PROMO' THEN 'framework' WHEN 'ECONOMY' THEN 'application'
            WHEN 'MEDIUM' THEN 'container' WHEN 'SMALL' THEN 'file' ELSE 'machine-learning-model' END AS type,
       replace(p_brand, '#', '-') AS comp_group, replace(p_name, ' ', '-') AS name,
       concat(CAST(p_size AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR), '.', CAST(l_suppkey % 10 AS VARCHAR)) AS version,
       concat('pkg:generic/', replace(p_brand, '#', '-'), '/', replace(p_name, ' ', '-'), '@', CAST(p_size AS VARCHAR), '.',
              CAST(l_linenumber AS VARCHAR), '.', CAST(l_suppkey % 10 AS VARCHAR)) AS purl,
       CASE l_returnflag WHEN 'A' THEN 'required' WHEN 'N' THEN 'optional' ELSE NULL END AS scope,
       l_linestatus = 'O' AS is_external,
       CASE l_partkey % 5 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'MIT' WHEN 2 THEN 'GPL-3.0-only' WHEN 3 THEN 'CC-BY-NC-4.0'
            ELSE 'Apache-2' END AS license_id,
       md5(concat(CAST(l_partkey AS VARCHAR), '/', CAST(l_suppkey AS VARCHAR))) AS hash_md5,
       l_partkey AS package_id, l_suppkey AS supplier_id, l_shipdate AS released_at
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "dependency_edge": """SELECT p_partkey AS ref, p_partkey * 2 + 1 AS depends_on FROM part
UNION ALL SELECT p_partkey, p_partkey * 2 + 2 FROM part
UNION ALL SELECT p_partkey, CAST(floor((p_partkey - 1) / 2) AS BIGINT) FROM part WHERE p_partkey > 0 AND p_partkey % 97 = 0""",
    "vulnerability": """SELECT event_id AS vuln_key, concat('CVE-2024-', lpad(CAST(event_id AS VARCHAR), 6, '0')) AS id,
       event_type AS source_name, user_id AS package_id, round(least(value / 10.0, 10.0), 1) AS score,
       CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium'
            WHEN value >= 1 THEN 'low' ELSE 'none' END AS severity,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS cwe,
       CASE event_id % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved_with_pedigree' WHEN 2 THEN 'exploitable'
            WHEN 3 THEN 'in_triage' WHEN 4 THEN 'false_positive' ELSE 'not_affected' END AS analysis_state,
       concat('vers:generic/>=', CAST(event_id % 40 AS VARCHAR), '.0.0|<', CAST(event_id % 40 + 10 AS VARCHAR), '.0.0') AS vers_range,
       ts AS published_at
FROM events""",
    "organization": """SELECT s_suppkey AS supplier_id, s_name AS name, n_name AS country, r_name AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "certificate": """SELECT o_orderkey AS cert_id, concat('CN=', CAST(o_custkey AS VARCHAR)) AS subject_name,
       o_orderdate AS not_valid_before, o_orderdate + INTERVAL '365' DAY AS not_valid_after,
       CASE o_orderstatus WHEN 'F' THEN 'deactivated' WHEN 'O' THEN 'active' ELSE 'pre-activation' END AS state,
       CAST(o_orderkey % 7 AS INT) AS nist_quantum_level
FROM orders""",
    "attestation_map": """SELECT l_orderkey AS attestation_id, l_partkey AS requirement_id, l_suppkey AS assessor_id,
       l_discount * 10 AS conformance_score, l_tax * 10 AS confidence_score, l_returnflag = 'R' AS counter_claim
FROM lineitem""",
    "energy": """SELECT l_partkey AS model_id,
       CASE l_linenumber WHEN 1 THEN 'design' WHEN 2 THEN 'data-collection' WHEN 3 THEN 'data-preparation'
            WHEN 4 THEN 'training' WHEN 5 THEN 'fine-tuning' WHEN 6 THEN 'validation' ELSE 'inference' END AS activity,
       l_quantity AS kwh, l_quantity * l_tax AS co2_cost_t, l_quantity * l_discount AS co2_offset_t
FROM lineitem""",
    "attached_text": """SELECT doc_id, lang AS locale, source, text,
       CASE WHEN text LIKE '%Apache License, Version 2.0%' THEN 'Apache-2.0' WHEN text LIKE '%MIT License%' THEN 'MIT'
            WHEN text LIKE '%GNU General Public License, version 3%' THEN 'GPL-3.0-only'
            WHEN text LIKE '%CC BY-NC 4.0%' THEN 'CC-BY-NC-4.0' END AS observed_license
FROM documents""",
    "external_reference": "SELECT page_id, 'website' AS type, url FROM pages",
    # in-document graph: component k of a document depends on component k+1
    "doc_edge": """SELECT DISTINCT l_orderkey AS bom_id, concat('c-', CAST(l_linenumber AS VARCHAR)) AS ref,
       concat('c-', CAST(l_linenumber + 1 AS VARCHAR)) AS target FROM lineitem""",
    "bom_link": """SELECT b.bom_id AS from_bom, c.bom_ref AS from_ref,
       concat('urn:cdx:', substr(b.serial_number, 10), '/', CAST(CASE WHEN c.package_id % 50 = 0 THEN b.version + 1000
              ELSE b.version END AS VARCHAR), '#', c.bom_ref) AS link
FROM bom b JOIN component c ON b.bom_id = c.bom_id""",
}
#: A line's texts take about 1.5 KB, held twice while they are grouped and sorted.
LINES_A_TASK = 100_000
VIEW_NEEDS = {"bom_link": ["bom", "component"]}


def with_views(views: str, body: str) -> str:
    """Oracle text: the named views as CTEs before ``body``."""
    wanted: list[str] = []
    for v in views.split():
        for n in [*VIEW_NEEDS.get(v, []), v]:
            if n not in wanted:
                wanted.append(n)
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in wanted)
    body = body.strip()
    starts_cte = not body.upper().startswith(("SELECT", "("))
    if not ctes:
        return ("WITH RECURSIVE " if starts_cte else "") + body
    return f"WITH RECURSIVE {ctes}{', ' if starts_cte else ' '}{body}"


class Tables:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # the tables hold zone-less times; documents carry them as UTC
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bom(self) -> DataFrame:
        o = self.raw("orders")
        # the running version number is the only ordered step; its group is one serial number
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        pr = F.substring("o_orderpriority", 1, 1)
        return o.select(
            F.col("o_orderkey").alias("bom_id"),
            F.format_string("urn:uuid:%08x-0000-4000-8000-%012x", "o_custkey", "o_custkey").alias("serial_number"),
            F.row_number().over(w).cast("int").alias("version"),
            F.concat(F.lit("1."), (3 + F.col("o_orderkey") % 5).cast("string")).alias("spec_version"),
            F.col("o_orderdate").alias("created_at"),
            F.when(pr == "5", "CLEAR").when(pr == "4", "GREEN").when(pr == "3", "AMBER")
            .when(pr == "2", "AMBER_AND_STRICT").otherwise("RED").alias("tlp"),
            F.when(F.col("o_orderstatus") == "P", "pre-build").when(F.col("o_orderstatus") == "O", "build")
            .otherwise("operations").alias("lifecycle_phase"),
        )

    def by_document(self, rows: DataFrame, key: str = "l_orderkey") -> DataFrame:
        """Rows dealt by document while they are narrow, so that the texts made
        of them don't move. The count is fixed, as the texts are far larger than
        the rows that adaptive execution would merge partitions by, and grows
        with the lines, so that the texts of a task stay in its memory."""
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_lines // LINES_A_TASK))
        return rows.repartition(n, key)

    @cached_property
    def n_lines(self) -> int:
        return self.raw("lineitem").count()

    @cached_property
    def component(self) -> DataFrame:
        return self.component_of(self._lines_of_parts())

    @cached_property
    def component_by_document(self) -> DataFrame:
        used = "l_orderkey l_linenumber l_partkey l_suppkey l_returnflag l_linestatus l_shipdate p_type p_brand p_name p_size".split()
        return self.component_of(self.by_document(self._lines_of_parts().select(*used)))

    @cached_property
    def line_by_document(self) -> DataFrame:
        return self.by_document(self.raw("lineitem"))

    def _lines_of_parts(self) -> DataFrame:
        li, p = self.raw("lineitem"), self.raw("part")
        return li.join(p, li.l_partkey == p.p_partkey)

    @staticmethod
    def component_of(lines: DataFrame) -> DataFrame:
        group = F.replace("p_brand", F.lit("#"), F.lit("-"))
        name = F.replace("p_name", F.lit(" "), F.lit("-"))
        version = F.concat_ws(".", F.col("p_size"), F.col("l_linenumber"), F.col("l_suppkey") % 10)
        ptype, mod = F.col("p_type"), F.col("l_partkey") % 5
        return lines.select(
            F.col("l_orderkey").alias("bom_id"),
            F.concat(F.lit("c-"), F.col("l_linenumber").cast("string")).alias("bom_ref"),
            F.when(ptype == "STANDARD", "library").when(ptype == "PROMO", "framework")
            .when(ptype == "ECONOMY", "application").when(ptype == "MEDIUM", "container")
            .when(ptype == "SMALL", "file").otherwise("machine-learning-model").alias("type"),
            group.alias("comp_group"),
            name.alias("name"),
            version.alias("version"),
            F.concat(F.lit("pkg:generic/"), group, F.lit("/"), name, F.lit("@"), version).alias("purl"),
            F.when(F.col("l_returnflag") == "A", "required").when(F.col("l_returnflag") == "N", "optional").alias("scope"),
            (F.col("l_linestatus") == "O").alias("is_external"),
            F.when(mod == 0, "Apache-2.0").when(mod == 1, "MIT").when(mod == 2, "GPL-3.0-only")
            .when(mod == 3, "CC-BY-NC-4.0").otherwise("Apache-2").alias("license_id"),
            F.md5(F.concat_ws("/", "l_partkey", "l_suppkey")).alias("hash_md5"),
            F.col("l_partkey").alias("package_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_shipdate").alias("released_at"),
        )

    @cached_property
    def dependency_edge(self) -> DataFrame:
        p = self.raw("part").select(F.col("p_partkey").alias("ref"))
        kids = F.array(F.col("ref") * 2 + 1, F.col("ref") * 2 + 2)
        back = F.when(
            (F.col("ref") > 0) & (F.col("ref") % 97 == 0), F.array(F.floor((F.col("ref") - 1) / 2).cast("bigint"))
        ).otherwise(F.array().cast("array<bigint>"))
        return p.select("ref", F.explode(F.concat(kids, back)).alias("depends_on"))

    @cached_property
    def forward_edge(self) -> DataFrame:
        """Dependency edges without the back edges: a forest."""
        return self.dependency_edge.filter(F.col("depends_on") > F.col("ref"))

    @staticmethod
    def vulnerability_of(ev: DataFrame) -> DataFrame:
        v, k = F.col("value"), F.col("event_id")
        return ev.select(
            k.alias("vuln_key"),
            F.concat(F.lit("CVE-2024-"), F.lpad(k.cast("string"), 6, "0")).alias("id"),
            F.col("event_type").alias("source_name"),
            F.col("user_id").alias("package_id"),
            F.round(F.least(v / 10.0, F.lit(10.0)), 1).alias("score"),
            F.when(v >= 90, "critical").when(v >= 70, "high").when(v >= 40, "medium").when(v >= 1, "low")
            .otherwise("none").alias("severity"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("cwe"),
            F.when(k % 6 == 0, "resolved").when(k % 6 == 1, "resolved_with_pedigree").when(k % 6 == 2, "exploitable")
            .when(k % 6 == 3, "in_triage").when(k % 6 == 4, "false_positive").otherwise("not_affected")
            .alias("analysis_state"),
            F.concat(
                F.lit("vers:generic/>="), (k % 40).cast("string"), F.lit(".0.0|<"), (k % 40 + 10).cast("string"),
                F.lit(".0.0"),
            ).alias("vers_range"),
            F.col("ts").alias("published_at"),
        )

    @cached_property
    def vulnerability(self) -> DataFrame:
        return self.vulnerability_of(self.raw("events"))

    @cached_property
    def organization(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"),
                F.col("n_name").alias("country"), F.col("r_name").alias("region"),
            )
        )

    @cached_property
    def certificate(self) -> DataFrame:
        st = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("cert_id"),
            F.concat(F.lit("CN="), F.col("o_custkey").cast("string")).alias("subject_name"),
            F.col("o_orderdate").alias("not_valid_before"),
            (F.col("o_orderdate") + F.expr("INTERVAL '365' DAY")).alias("not_valid_after"),
            F.when(st == "F", "deactivated").when(st == "O", "active").otherwise("pre-activation").alias("state"),
            (F.col("o_orderkey") % 7).cast("int").alias("nist_quantum_level"),
        )

    @cached_property
    def attestation_map(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("attestation_id"),
            F.col("l_partkey").alias("requirement_id"),
            F.col("l_suppkey").alias("assessor_id"),
            (F.col("l_discount") * 10).alias("conformance_score"),
            (F.col("l_tax") * 10).alias("confidence_score"),
            (F.col("l_returnflag") == "R").alias("counter_claim"),
        )

    @cached_property
    def energy(self) -> DataFrame:
        n = F.col("l_linenumber")
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("model_id"),
            F.when(n == 1, "design").when(n == 2, "data-collection").when(n == 3, "data-preparation")
            .when(n == 4, "training").when(n == 5, "fine-tuning").when(n == 6, "validation").otherwise("inference")
            .alias("activity"),
            F.col("l_quantity").alias("kwh"),
            (F.col("l_quantity") * F.col("l_tax")).alias("co2_cost_t"),
            (F.col("l_quantity") * F.col("l_discount")).alias("co2_offset_t"),
        )

    @cached_property
    def attached_text(self) -> DataFrame:
        d, t = self.raw("documents"), F.col("text")
        return d.select(
            "doc_id", F.col("lang").alias("locale"), "source", "text",
            F.when(t.contains("Apache License, Version 2.0"), "Apache-2.0").when(t.contains("MIT License"), "MIT")
            .when(t.contains("GNU General Public License, version 3"), "GPL-3.0-only")
            .when(t.contains("CC BY-NC 4.0"), "CC-BY-NC-4.0").alias("observed_license"),
        )

    @cached_property
    def external_reference(self) -> DataFrame:
        return self.raw("pages").select("page_id", F.lit("website").alias("type"), "url")

    @cached_property
    def doc_edge(self) -> DataFrame:
        return self.doc_edge_of(self.raw("lineitem"))

    @cached_property
    def doc_edge_by_document(self) -> DataFrame:
        return self.doc_edge_of(self.by_document(self.raw("lineitem").select("l_orderkey", "l_linenumber")))

    @staticmethod
    def doc_edge_of(lines: DataFrame) -> DataFrame:
        n = F.col("l_linenumber")
        # told apart by number, so that no texts are grouped
        return lines.select("l_orderkey", "l_linenumber").distinct().select(
            F.col("l_orderkey").alias("bom_id"),
            F.concat(F.lit("c-"), n.cast("string")).alias("ref"),
            F.concat(F.lit("c-"), (n + 1).cast("string")).alias("target"),
        )

    @cached_property
    def package(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("package_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")
        )

    @cached_property
    def bom_link(self) -> DataFrame:
        b = self.bom.select("bom_id", "serial_number", "version")
        c = self.component.select("bom_id", "bom_ref", "package_id")
        shown = F.when(F.col("package_id") % 50 == 0, F.col("version") + 1000).otherwise(F.col("version"))
        return b.join(c, "bom_id").select(
            F.col("bom_id").alias("from_bom"),
            F.col("bom_ref").alias("from_ref"),
            F.concat(
                F.lit("urn:cdx:"), F.substring("serial_number", 10, 36), F.lit("/"), shown.cast("string"), F.lit("#"),
                F.col("bom_ref"),
            ).alias("link"),
        )
