"""Ordered operators. "Newest per key" is an aggregate; running values over
long keys are split by bucket; top-k per key uses ``row_number <= k``, which
the optimizer limits before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .skew import newest_per_key, split_lag


def latest_bom(boms: DataFrame) -> DataFrame:
    """Newest version per serial number; a document without a serial number
    stands for itself."""
    named = newest_per_key(
        boms.filter("serial_number IS NOT NULL"), ["serial_number"], [F.col("version"), F.col("bom_id")]
    )
    return named.unionByName(boms.filter("serial_number IS NULL"))


def version_gaps(boms: DataFrame) -> DataFrame:
    """Places where the version does not follow the one before it by exactly 1."""
    lagged = split_lag(
        boms.select("serial_number", "version", "bom_id"), ["serial_number"], ["version", "bom_id"],
        F.floor(F.col("version") / 64), {"previous": "version"},
    )
    kind = (
        F.when(F.col("previous").isNull() & (F.col("version") > 1), "missing")
        .when(F.col("version") == F.col("previous"), "repeated")
        .when(F.col("version") > F.col("previous") + 1, "missing")
    )
    return lagged.withColumn("kind", kind).filter("kind IS NOT NULL")


def latest_analysis(analyses: DataFrame, keys: list[str]) -> DataFrame:
    return newest_per_key(analyses, keys, [F.col("published_at"), F.col("vuln_key")])


def rank_ratings(ratings: DataFrame, key: str) -> DataFrame:
    """Ranks of distinct scores inside a vulnerability: equal scores share a
    rank, so counts per score are ranked and no row is sorted twice."""
    per = ratings.groupBy(key, "score").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(key))
    pct = F.when(total > 1, before / (total - 1)).otherwise(F.lit(0.0))
    return per.select(
        key, "score", "n", (before + 1).cast("int").alias("rank"),
        F.dense_rank().over(w).alias("dense_rank"), F.round(pct, 6).alias("percent_rank"),
    )


def component_timeline(presence: DataFrame) -> DataFrame:
    """Islands of consecutive document versions that hold a package.
    ``presence(serial_number, package, version)``.

    Each row says "here" for its version and "before" for the next one; where
    both meet the island goes on. One aggregate finds the starts, with no
    ordered window over a long history."""
    marks = F.array(
        F.struct(F.col("version").alias("v"), F.lit(True).alias("here")),
        F.struct((F.col("version") + 1).alias("v"), F.lit(False).alias("here")),
    )
    at = presence.select("serial_number", "package", F.inline(marks)).groupBy("serial_number", "package", "v").agg(
        F.bool_or("here").alias("here"), F.bool_and("here").alias("start")
    )
    return at.filter("here").groupBy("serial_number", "package").agg(
        F.min("v").alias("first_version"), F.max("v").alias("last_version"), (F.count_if("start") - 1).alias("reintroductions")
    )


def cumulative_vulnerabilities(vulns: DataFrame, unit: str = "day") -> DataFrame:
    """Running count per source by time unit; rows are counted per unit first."""
    per = vulns.groupBy("source_name", F.date_trunc(unit, "published_at").cast("timestamp_ntz").alias("since")).agg(
        F.count("*").alias("n")
    )
    w = Window.partitionBy("source_name").orderBy("since").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("n_total", F.sum("n").over(w))


def rolling_vulnerabilities(vulns: DataFrame, days: int = 7) -> DataFrame:
    """Moving count over the last ``days`` days, per source and day."""
    per = vulns.groupBy("source_name", F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_name").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return per.withColumn("n_window", F.sum("n").over(w))


def best_identity(identities: DataFrame) -> DataFrame:
    """Concluded value with the highest confidence per component and field."""
    return newest_per_key(
        identities, ["bom_id", "owner_pointer", "field"], [F.coalesce("confidence", F.lit(-1.0)), F.col("concluded_value")]
    )


def time_between_versions(boms: DataFrame) -> DataFrame:
    """Days since the version before, and the mean of the last three gaps."""
    keys, bucket = ["serial_number"], F.floor(F.col("version") / 64)
    d1 = split_lag(boms, keys, ["version"], bucket, {"_p1": "created_at"})
    d2 = split_lag(d1, keys, ["version"], bucket, {"_p2": "_p1"})
    d3 = split_lag(d2, keys, ["version"], bucket, {"_p3": "_p2"})
    gap = lambda a, b: F.date_diff(a, b)
    gaps = F.filter(
        F.array(gap("created_at", "_p1"), gap("_p1", "_p2"), gap("_p2", "_p3")), lambda x: x.isNotNull()
    )
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(gaps), F.lit(0))
    return d3.withColumn("days", gap("created_at", "_p1")).withColumn("mean_last_3", F.round(mean, 6)).drop("_p1", "_p2", "_p3")


def severity_quartiles(vulns: DataFrame) -> DataFrame:
    """Quartile and cumulative share of each distinct score per source."""
    per = vulns.groupBy("source_name", "score").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_name").orderBy("score")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("source_name"))
    # quartile of the last row that has this score, as ntile(4) numbers it
    base, extra = F.floor(total / 4), total % 4
    big = extra * (base + 1)
    tile = F.when(upto <= big, F.ceil(upto / (base + 1))).otherwise(extra + F.ceil((upto - big) / base))
    return per.select(
        "source_name", "score", "n", tile.cast("int").alias("quartile"), F.round(upto / total, 6).alias("cume_dist")
    )


def cert_state_sequence(states: DataFrame, order: list[str]) -> DataFrame:
    """Successive certificate states (bom_id, ref, position, state) with the
    number of states stepped over in the usual order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("state"))
    w = Window.partitionBy("bom_id", "ref").orderBy("position")
    nxt = F.lead("state").over(w)
    nrank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("next_state"))
    return states.withColumn("next_state", nxt).withColumn("skipped", (nrank - rank - 1).cast("int"))


def rating_change(vulns: DataFrame) -> DataFrame:
    """Score of the record before, per (package, source), and the change."""
    lagged = split_lag(
        vulns.select("package_id", "source_name", "published_at", "vuln_key", "score"), ["package_id", "source_name"],
        ["published_at", "vuln_key"], F.date_trunc("week", "published_at"), {"previous_score": "score"},
    )
    return lagged.withColumn("delta", F.round(F.col("score") - F.col("previous_score"), 6))


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def oldest_open(vulns: DataFrame, closed: tuple[str, ...], k: int) -> DataFrame:
    return vulns.filter(~F.col("analysis_state").isin(*closed)).orderBy(
        F.col("published_at").asc_nulls_last(), "vuln_key"
    ).limit(k)


def top_risk_components(components: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """Packages by highest open score; only packages take part in the sort."""
    names = components.groupBy("package_id").agg(F.min("name").alias("name"), F.count("*").alias("n_components"))
    risk = matched.groupBy("package_id").agg(F.max("max_score").alias("max_score"))
    return names.join(risk, "package_id").orderBy(F.desc("max_score"), F.desc("n_components"), "name", "package_id").limit(k)


def sort_inventory(components: DataFrame, version_key: Column) -> DataFrame:
    """Canonical order: type, group, name, version (by key), then ids; with the
    ``position`` (from 1) of each row. Spark sorts by range; the rows of the
    ranges before are added to the place within a range."""
    order = ["type", "comp_group", "name", F.col("_k").asc_nulls_first(), "bom_id", "bom_ref", "supplier_id"]
    rows = cut(components.withColumn("_k", version_key).orderBy(*order).drop("_k").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = rows.groupBy(part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", "_first", before.alias("_before"))
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn("position", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_first", "_before", "_at")
