"""Queries for ordered operators, top-k and sorts."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import enums as en
from ..operators import joins as J, windows as W
from .registry import query

CLOSED = "('resolved', 'resolved_with_pedigree', 'false_positive', 'not_affected')"
MAJOR = "CAST(split_part(version, '.', 1) AS INT)"


@query(
    "latest_bom",
    "SELECT bom_id, serial_number, version, spec_version, created_at, tlp, lifecycle_phase FROM (SELECT *, row_number() OVER (PARTITION BY serial_number ORDER BY version DESC) AS rn FROM bom) x WHERE rn = 1",
    "bom",
)
def _(t):
    return W.latest_bom(t.bom)


@query(
    "version_gaps",
    """kept AS (SELECT serial_number, version + version // 3 AS version FROM bom),
l AS (SELECT serial_number, version, lag(version) OVER (PARTITION BY serial_number ORDER BY version) AS previous FROM kept)
SELECT serial_number, version, previous, 'missing' AS kind FROM l WHERE version > coalesce(previous, 0) + 1""",
    "bom",
)
def _(t):
    # every third number is skipped
    return W.version_gaps(t.bom.withColumn("version", (F.col("version") + F.floor(F.col("version") / 3)).cast("int"))).select("serial_number", "version", "previous", "kind")


@query(
    "latest_analysis",
    """SELECT package_id, source_name, id, analysis_state, published_at FROM (SELECT *, row_number() OVER
(PARTITION BY package_id, source_name ORDER BY published_at DESC, vuln_key DESC) AS rn FROM vulnerability) x WHERE rn = 1""",
    "vulnerability",
)
def _(t):
    return W.latest_analysis(t.vulnerability, ["package_id", "source_name"]).select(
        "package_id", "source_name", "id", "analysis_state", "published_at"
    )


@query(
    "rank_ratings",
    """r AS (SELECT package_id, score, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS pr FROM vulnerability
WINDOW w AS (PARTITION BY package_id ORDER BY score DESC))
SELECT package_id, score, count(*) AS n, CAST(min(rank) AS INT) AS rank, CAST(min(dense_rank) AS INT) AS dense_rank, round(min(pr), 6) AS percent_rank FROM r GROUP BY 1, 2""",
    "vulnerability",
)
def _(t):
    return W.rank_ratings(t.vulnerability, "package_id")


@query(
    "component_timeline",
    """p AS (SELECT DISTINCT serial_number, split_part(purl, '@', 1) AS package, b.version FROM bom b JOIN component c ON c.bom_id = b.bom_id),
l AS (SELECT *, lag(version) OVER (PARTITION BY serial_number, package ORDER BY version) AS prev FROM p)
SELECT serial_number, package, min(version) AS first_version, max(version) AS last_version,
CAST(sum(CASE WHEN prev IS NULL OR version > prev + 1 THEN 1 ELSE 0 END) - 1 AS BIGINT) AS reintroductions FROM l GROUP BY 1, 2""",
    "bom component",
)
def _(t):
    p = t.bom.select("bom_id", "serial_number", "version").join(
        t.component.select("bom_id", S.purl_without_version("purl").alias("package")), "bom_id"
    )
    return W.component_timeline(p.select("serial_number", "package", "version"))


@query(
    "cumulative_vulnerabilities",
    """d AS (SELECT source_name, CAST(date_trunc('day', published_at) AS TIMESTAMP) AS since, count(*) AS n FROM vulnerability GROUP BY 1, 2)
SELECT source_name, since, n, CAST(sum(n) OVER (PARTITION BY source_name ORDER BY since) AS BIGINT) AS n_total FROM d""",
    "vulnerability",
)
def _(t):
    return W.cumulative_vulnerabilities(t.vulnerability)


@query(
    "rolling_vulnerabilities",
    """d AS (SELECT source_name, CAST(published_at AS DATE) AS day, count(*) AS n FROM vulnerability GROUP BY 1, 2)
SELECT source_name, day, n, CAST(sum(n) OVER (PARTITION BY source_name ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n_window FROM d""",
    "vulnerability",
)
def _(t):
    return W.rolling_vulnerabilities(t.vulnerability)


@query(
    "time_between_versions",
    """g AS (SELECT serial_number, version, CAST(date_diff('day', lag(created_at) OVER w, created_at) AS INT) AS days FROM bom WINDOW w AS (PARTITION BY serial_number ORDER BY version))
SELECT serial_number, version, days, round(avg(days) OVER (PARTITION BY serial_number ORDER BY version ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_last_3 FROM g""",
    "bom",
)
def _(t):
    b = t.bom.select("serial_number", "version", "created_at")
    return W.time_between_versions(b).select("serial_number", "version", "days", "mean_last_3")


@query(
    "severity_quartiles",
    """r AS (SELECT source_name, score, ntile(4) OVER (PARTITION BY source_name ORDER BY score) AS q, cume_dist() OVER (PARTITION BY source_name ORDER BY score) AS cd FROM vulnerability)
SELECT source_name, score, count(*) AS n, CAST(max(q) AS INT) AS quartile, round(max(cd), 6) AS cume_dist FROM r GROUP BY 1, 2""",
    "vulnerability",
)
def _(t):
    return W.severity_quartiles(t.vulnerability)


@query(
    "rating_change",
    """SELECT package_id, source_name, vuln_key, score, previous_score, round(score - previous_score, 6) AS delta FROM
(SELECT *, lag(score) OVER (PARTITION BY package_id, source_name ORDER BY published_at, vuln_key) AS previous_score FROM vulnerability) x""",
    "vulnerability",
)
def _(t):
    return W.rating_change(t.vulnerability).select("package_id", "source_name", "vuln_key", "score", "previous_score", "delta")


LO = "CAST(split_part(split_part(vers_range, '>=', 2), '.', 1) AS INT)"
HI = "CAST(split_part(split_part(vers_range, '<', 2), '.', 1) AS INT)"


@query(
    "top_risk_components",
    f"""pv AS (SELECT package_id, version, count(*) AS n FROM component GROUP BY 1, 2),
m AS (SELECT pv.package_id, max(v.score) AS max_score FROM pv JOIN (SELECT package_id, score, {LO} AS lo, {HI} AS hi FROM vulnerability WHERE analysis_state NOT IN {CLOSED}) v
 ON v.package_id = pv.package_id AND {MAJOR} >= lo AND {MAJOR} < hi GROUP BY 1),
n AS (SELECT package_id, min(name) AS name, count(*) AS n_components FROM component GROUP BY 1)
SELECT n.package_id, name, n_components, max_score FROM n JOIN m ON n.package_id = m.package_id ORDER BY max_score DESC, n_components DESC, name, package_id LIMIT 25""",
    "component vulnerability",
)
def _(t):
    open_v = t.vulnerability.filter(~F.col("analysis_state").isin(*en.CLOSED_STATES))
    return W.top_risk_components(t.component, J.match_vulnerabilities(t.component, open_v), 25)


@query(
    "top_k_per_bom",
    f"""m AS (SELECT c.bom_id, v.vuln_key, v.score, row_number() OVER (PARTITION BY c.bom_id ORDER BY v.score DESC, v.vuln_key) AS rank
FROM (SELECT DISTINCT bom_id, package_id FROM component) c JOIN vulnerability v ON v.package_id = c.package_id WHERE v.analysis_state NOT IN {CLOSED})
SELECT bom_id, vuln_key, score, CAST(rank AS INT) AS rank FROM m WHERE rank <= 3""",
    "component vulnerability",
)
def _(t):
    # only the best 3 of a package can be among the best 3 of a document
    open_v = t.vulnerability.filter(~F.col("analysis_state").isin(*en.CLOSED_STATES))
    best = W.top_k_per_key(
        open_v.select("package_id", "vuln_key", "score"), ["package_id"], [F.desc("score"), F.col("vuln_key")], 3
    ).drop("rank")
    docs = t.component.select("bom_id", "package_id").distinct()
    got = W.top_k_per_key(docs.join(best, "package_id"), ["bom_id"], [F.desc("score"), F.col("vuln_key")], 3)
    return got.select("bom_id", "vuln_key", "score", "rank")


@query(
    "oldest_open",
    f"SELECT vuln_key, id, source_name, published_at FROM vulnerability WHERE analysis_state NOT IN {CLOSED} ORDER BY published_at NULLS LAST, vuln_key LIMIT 50",
    "vulnerability",
)
def _(t):
    return W.oldest_open(t.vulnerability, en.CLOSED_STATES, 50).select("vuln_key", "id", "source_name", "published_at")


@query(
    "sort_inventory",
    """SELECT bom_id, bom_ref, type, comp_group, name, version, row_number() OVER (ORDER BY type, comp_group, name,
CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT), bom_id, bom_ref, supplier_id) AS position FROM component""",
    "component",
)
def _(t):
    return W.sort_inventory(t.component, S.version_key("version")).select(
        "bom_id", "bom_ref", "type", "comp_group", "name", "version", "position"
    )
