"""Streaming queries: the table is written as files, read as a stream with
``availableNow`` and has to end with the rows of the batch statement.

A last file holds one row far in the future. It moves the watermark past all
real rows, so append mode emits every window; its own window stays behind.
"""

from pyspark.sql import functions as F, types as T

from ..session import scratch_path
from ..sources import documents as docs_io
from ..operators import flatten as X
from ..streaming import jobs as J
from .q_docs import doc_query
from .q_misc import plain_documents


def staged(t, df, time_column, closing=True):
    """Table as Parquet files plus the closing row; returns it as a stream."""
    zoned = df.withColumn(time_column, F.col(time_column).cast("timestamp"))
    out = scratch_path(t.spark, "stream-in")
    zoned.write.parquet(f"{out}/a")
    if closing:
        last = t.spark.read.parquet(f"{out}/a").agg((F.max(time_column) + F.expr("INTERVAL 400 DAYS")).alias("_t"))
        blank = [F.col("_t").alias(f.name) if f.name == time_column else F.lit(None).cast(f.dataType).alias(f.name) for f in zoned.schema]
        last.select(*blank).write.parquet(f"{out}/b")
    return J.file_stream(t.spark, f"{out}/*", zoned.schema)


def vulns(t):
    return staged(t, t.vulnerability, "published_at")


@doc_query(
    "stream_severity_tumbling",
    "SELECT CAST(time_bucket(INTERVAL 1 HOUR, published_at, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS window_start, severity, count(*) AS n FROM vulnerability GROUP BY 1, 2",
    "vulnerability",
)
def _(t):
    return J.run_append(J.severity_tumbling(vulns(t)), "tumbling")


@doc_query(
    "stream_severity_sliding",
    """b AS (SELECT time_bucket(INTERVAL 6 HOUR, published_at, TIMESTAMP '1970-01-01') AS w, severity FROM vulnerability)
SELECT CAST(w - INTERVAL (6 * i) HOUR AS TIMESTAMP) AS window_start, severity, count(*) AS n FROM b, range(4) r(i) GROUP BY 1, 2""",
    "vulnerability",
)
def _(t):
    return J.run_append(J.severity_sliding(vulns(t)), "sliding")


@doc_query(
    "stream_scan_sessions",
    """g AS (SELECT package_id, published_at, CASE WHEN published_at >= lag(published_at) OVER (PARTITION BY package_id ORDER BY published_at) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS s FROM vulnerability),
i AS (SELECT package_id, published_at, sum(s) OVER (PARTITION BY package_id ORDER BY published_at) AS island FROM g)
SELECT package_id, min(published_at) AS session_start, max(published_at) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM i GROUP BY package_id, island""",
    "vulnerability",
)
def _(t):
    return J.run_append(J.scan_sessions(vulns(t)), "sessions")


@doc_query("stream_dedupe", "SELECT DISTINCT package_id, source_name FROM vulnerability", "vulnerability")
def _(t):
    got = J.dedupe(vulns(t), ["package_id", "source_name"], "90 days").filter("vuln_key IS NOT NULL")
    return J.run_append(got.select("package_id", "source_name"), "dedupe")


@doc_query(
    "stream_match_inventory",
    """SELECT v.vuln_key, v.package_id, severity, n_components FROM vulnerability v JOIN (SELECT package_id, count(*) AS n_components FROM component GROUP BY 1) c ON c.package_id = v.package_id""",
    "component vulnerability",
)
def _(t):
    inventory = t.component.groupBy("package_id").agg(F.count("*").alias("n_components"))
    got = J.match_inventory(vulns(t), inventory)
    return J.run_append(got.select("vuln_key", "package_id", "severity", "n_components"), "match")


@doc_query(
    "stream_bom_vuln_join",
    """r AS (SELECT package_id, TIMESTAMP '2024-01-01' + INTERVAL (bom_id % 30) DAY AS released_at, count(*) AS n_documents FROM component GROUP BY 1, 2)
SELECT v.vuln_key, v.package_id, r.released_at, r.n_documents FROM vulnerability v JOIN r ON r.package_id = v.package_id AND r.released_at <= v.published_at AND r.released_at >= v.published_at - INTERVAL 7 DAY""",
    "component vulnerability",
)
def _(t):
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("bom_id") % 30).cast("int"))
    releases = t.component.groupBy("package_id", day.alias("released_at")).agg(F.count("*").alias("n_documents"))
    got = J.releases_near_vulnerabilities(staged(t, releases, "released_at"), vulns(t))
    return J.run_append(got.select("vuln_key", "package_id", "released_at", "n_documents"), "near")


@doc_query(
    "stream_latest_bom",
    "SELECT serial_number, bom_id, version, tlp FROM (SELECT *, row_number() OVER (PARTITION BY serial_number ORDER BY version DESC) AS rn FROM bom) x WHERE rn = 1",
    "bom",
)
def _(t):
    b = staged(t, t.bom.select("serial_number", "bom_id", "version", "tlp", "created_at"), "created_at", closing=False)
    return J.run_upsert(J.latest_documents(b.drop("created_at")), "latest", ["serial_number"])


@doc_query(
    "stream_late_records",
    """m AS (SELECT max(published_at) AS newest FROM vulnerability WHERE vuln_key % 2 = 0)
SELECT vuln_key, vuln_key % 2 = 1 AND published_at < newest - INTERVAL 10 DAY AS late FROM vulnerability, m""",
    "vulnerability",
)
def _(t):
    # two deliveries: even records first, then the odd ones, most of them behind
    v = t.vulnerability.select("vuln_key", F.col("published_at").cast("timestamp").alias("published_at"))
    out = scratch_path(t.spark, "stream-late-in")
    v.filter("vuln_key % 2 = 0").write.parquet(f"{out}/a")
    stream = J.file_stream(t.spark, f"{out}/*", v.schema, max_files=None)
    second = lambda: v.filter("vuln_key % 2 = 1").write.parquet(f"{out}/b")
    on_time, late = J.split_late(stream, "published_at", "10 DAYS", "late", (second,))
    return on_time.select("vuln_key", F.lit(False).alias("late")).unionByName(late.select("vuln_key", F.lit(True).alias("late")))


@doc_query(
    "stream_analysis_state",
    """s AS (SELECT package_id, source_name, arg_max(analysis_state, {'t': published_at, 'k': vuln_key}) AS state, min(published_at) FILTER (analysis_state = 'in_triage') AS triage_since, max(published_at) AS updated_at,
max(published_at) FILTER (analysis_state = 'in_triage') AS last_triage FROM vulnerability GROUP BY 1, 2)
SELECT package_id, source_name, state, triage_since, updated_at,
CAST(floor(epoch(CASE WHEN state = 'in_triage' THEN updated_at ELSE last_triage END)) - floor(epoch(triage_since)) AS BIGINT) AS seconds_in_triage FROM s""",
    "vulnerability",
)
def _(t):
    a = staged(t, t.vulnerability.select("package_id", "source_name", "analysis_state", "published_at", "vuln_key"), "published_at", closing=False)
    return J.run_upsert(J.analysis_state(a), "analysis", ["package_id", "source_name"])


@doc_query(
    "stream_expiry_alerts",
    """w AS (SELECT max(not_valid_before) - INTERVAL 1 DAY AS mark FROM certificate)
SELECT cert_id, not_valid_after FROM certificate, w WHERE not_valid_after - INTERVAL 30 DAY <= mark""",
    "certificate",
)
def _(t):
    c = t.certificate.select("cert_id", F.col("not_valid_before").alias("at"), F.col("not_valid_after").cast("timestamp").alias("not_valid_after"))
    return J.run_append(J.expiry_alerts(staged(t, c, "at", closing=False)), "expiry")


@doc_query("stream_bom_files", "SELECT serial_number, version, spec_version, created_at, tlp FROM bom", "bom")
def _(t):
    out = scratch_path(t.spark, "stream-docs")
    docs_io.write_bom_json(plain_documents(t), out)
    stream = docs_io.stream_bom_files(t.spark, out)
    got = J.run_append(X.bom_table(stream), "stream-docs-out")
    return got.select("serial_number", "version", "spec_version", "created_at", "tlp")
