"""Aggregations over the model's tables. Distinct counts are two plain
group-bys, so the first one combines on the map side and no key is expanded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..model import enums as en


def exact_mean(c) -> Column:
    """Mean whose sum is decimal, the same digits in any order of the rows,
    where the values are decimals of at most 12 places; else the plain mean."""
    col = F.col(c) if isinstance(c, str) else c
    wide = F.when(F.abs(col) < 1e15, col.try_cast("decimal(38,12)"))
    other = F.count_if(col.isNotNull() & ~F.coalesce(wide.cast("double") == col, F.lit(False)))
    return F.when(other == 0, F.sum(wide).cast("double") / F.count(col)).otherwise(F.avg(col))


def inventory_counts(components: DataFrame, dims: list[str]) -> DataFrame:
    """Counts over every combination of the dimensions, totals marked by ``level``."""
    return components.cube(*dims).agg(F.count("*").alias("n"), F.grouping_id(*dims).alias("level"))


def distinct_packages(components: DataFrame, by: str) -> DataFrame:
    exact = components.groupBy(by, "purl").agg(F.count("*").alias("_n"))
    return exact.groupBy(by).agg(F.count("*").alias("n_packages"), F.sum("_n").alias("n_components"))


def distinct_packages_approx(components: DataFrame, by: str, error: float = 0.02) -> DataFrame:
    return components.groupBy(by).agg(F.approx_count_distinct("purl", error).alias("n_packages"))


def version_spread(components: DataFrame) -> DataFrame:
    """Versions in use per package. The distinct pairs are formed first, so a
    list holds each version once."""
    pv = components.select("package", "version").distinct()
    return pv.groupBy("package").agg(
        F.count("*").alias("n_versions"), F.array_sort(F.collect_list("version")).alias("versions")
    )


def license_distribution(license_uses: DataFrame) -> DataFrame:
    per = license_uses.groupBy("license_id").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("_t")).scalar()
    return per.select("license_id", "n", F.round(F.col("n") / total, 6).alias("share"))


def license_families(components: DataFrame) -> DataFrame:
    per = components.groupBy("license_id", "type").agg(F.count("*").alias("_n"))
    return per.groupingSets(
        [[F.col("license_id")], [F.col("type")], [F.col("license_id"), F.col("type")]], F.col("license_id"), F.col("type")
    ).agg(F.sum("_n").alias("n"), F.grouping_id("license_id", "type").alias("level"))


def severity_summary(vulns: DataFrame) -> DataFrame:
    """Counts by source x state, one column per severity."""
    cols = [F.count_if(F.col("severity") == s).alias(s) for s in en.SEVERITIES]
    return vulns.groupBy("source_name", "analysis_state").agg(*cols)


def rating_consensus(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(
        F.max("score").alias("max_score"), F.round(exact_mean("score"), 10).alias("mean_score"),
        F.round(F.max("score") - F.min("score"), 6).alias("spread"), F.count("*").alias("n_ratings"),
        F.count_distinct("source_name").alias("n_sources"),
    )


def open_exposure(components: DataFrame, vulns: DataFrame) -> DataFrame:
    """Open vulnerabilities per document; vulnerabilities are counted per
    package before they meet the components."""
    per = vulns.groupBy("package_id").agg(
        F.count_if(~F.col("analysis_state").isin(*en.CLOSED_STATES)).alias("_open"), F.count("*").alias("_all")
    )
    docs = components.select("bom_id", "package_id").distinct()
    return docs.join(per, "package_id").groupBy("bom_id").agg(
        F.sum("_open").alias("n_open"), F.sum("_all").alias("n_reported")
    )


def identity_confidence(methods: DataFrame, keys: list[str]) -> DataFrame:
    return methods.groupBy(*keys).agg(
        F.max_by("technique", F.struct("confidence", "technique")).alias("best_technique"),
        F.max("confidence").alias("best_confidence"), F.round(exact_mean("confidence"), 10).alias("mean_confidence"),
    )


def composition_completeness(refs: DataFrame, compositions: DataFrame) -> DataFrame:
    """Least complete statement per element; an element no composition lists is
    not specified. A statement about a parent does not reach its children."""
    ranked = compositions.select("bom_id", "ref", S.aggregate_rank("aggregate").alias("_r"))
    least = ranked.groupBy("bom_id", "ref").agg(F.min("_r").alias("_r"))
    names = F.array(*[F.lit(a) for a in en.AGGREGATE_ORDER])
    return refs.select("bom_id", "ref").distinct().join(least, ["bom_id", "ref"], "left").select(
        "bom_id", "ref", F.coalesce(F.get(names, F.col("_r")), F.lit("not_specified")).alias("aggregate")
    )


def crypto_inventory(algorithms: DataFrame) -> DataFrame:
    return algorithms.select("*", F.explode_outer("functions").alias("function")).groupBy(
        "primitive", "family", "mode", "padding", "function"
    ).agg(F.count("*").alias("n"))


def quantum_readiness(assets: DataFrame, by: str) -> DataFrame:
    per = assets.groupBy(by, "nist_quantum_level").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)  # at most seven levels per group
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def energy_totals(energy: DataFrame) -> DataFrame:
    return energy.rollup("model_id", "activity").agg(
        F.round(F.sum("kwh"), 3).alias("kwh"), F.round(F.sum("co2_cost_t"), 3).alias("co2_cost_t"),
        F.round(F.sum("co2_offset_t"), 3).alias("co2_offset_t"),
        F.round(F.sum(S.net_co2("co2_cost_t", "co2_offset_t")), 3).alias("co2_net_t"),
        F.grouping_id("model_id", "activity").alias("level"),
    )


def energy_mix(providers: DataFrame) -> DataFrame:
    return providers.groupBy("energy_source").agg(
        F.count("*").alias("n"), F.round(F.sum("provided_kwh"), 3).alias("provided_kwh")
    )


def conformance_by_standard(maps: DataFrame, requirements: DataFrame) -> DataFrame:
    """Scores by requirement and level, with totals. Sums and counts are formed
    per requirement first."""
    per = maps.groupBy("requirement_id").agg(
        F.sum(F.col("conformance_score").cast("decimal(38,12)")).alias("_cs"), F.min("conformance_score").alias("_cm"),
        F.sum(F.col("confidence_score").cast("decimal(38,12)")).alias("_fs"), F.count("*").alias("_n"), F.count_if("counter_claim").alias("_cc"),
    )
    j = per.join(requirements, "requirement_id")
    return j.rollup("level", "requirement_id").agg(
        F.round(F.sum("_cs").cast("double") / F.sum("_n"), 10).alias("mean_conformance"), F.round(F.min("_cm"), 6).alias("min_conformance"),
        F.round(F.sum("_fs").cast("double") / F.sum("_n"), 10).alias("mean_confidence"), F.sum("_cc").alias("n_counter_claims"),
        F.grouping_id("level", "requirement_id").alias("grouping"),
    )


def tlp_merge(boms: DataFrame, by: str) -> DataFrame:
    return boms.groupBy(by).agg(F.max_by("tlp", S.tlp_rank("tlp")).alias("tlp"))


def cwe_top(vulns: DataFrame, k: int) -> DataFrame:
    return vulns.groupBy("cwe").agg(F.count("*").alias("n"), F.max("score").alias("max_score")).orderBy(
        F.desc("n"), "cwe"
    ).limit(k)


def supplier_concentration(components: DataFrame) -> DataFrame:
    """Share of the largest supplier and Herfindahl index per type."""
    per = components.groupBy("type", "supplier_id").agg(F.count("*").alias("n"))
    # sum(share^2) = sum(n^2) / sum(n)^2: no second pass over the rows
    return per.groupBy("type").agg(
        F.count("*").alias("n_suppliers"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"),
        F.round(F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n")), 6).alias("herfindahl"),
    )


def score_percentiles(ratings: DataFrame, by: str, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles. Scores repeat, so they are counted first and the
    percentile takes the count as frequency."""
    per = ratings.groupBy(by, "score").agg(F.count("*").alias("_n"))
    return per.groupBy(by).agg(
        *[F.round(F.percentile("score", F.lit(p), F.col("_n")), 6).alias(f"p{int(p * 100)}") for p in points]
    )


def score_percentiles_approx(ratings: DataFrame, by: str, points: list[float]) -> DataFrame:
    return ratings.groupBy(by).agg(F.percentile_approx("score", points, 10000).alias("quantiles"))


def hash_alg_usage(hashes: DataFrame) -> DataFrame:
    """Per document and overall: algorithms in use and whether a weak one is among them."""
    per = hashes.groupBy("alg", "bom_id").agg(F.count("*").alias("_n"))
    return per.groupBy("alg").agg(
        F.count("*").alias("n_boms"), F.sum("_n").alias("n_hashes"), F.bool_or(F.col("alg").isin(*en.WEAK_HASHES)).alias("weak")
    )


def reference_pivot(owners: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """One count column per fixed value."""
    cols = [F.count_if(F.col(column) == v).alias(v.replace("-", "_")) for v in values]
    return owners.groupBy(key).agg(*cols)


def flow_matrix(flows: DataFrame) -> DataFrame:
    return reference_pivot(flows, "classification", "direction", en.FLOW_DIRECTIONS)


def evidence_techniques(methods: DataFrame) -> DataFrame:
    return methods.groupBy("technique").agg(
        F.count("*").alias("n"), F.round(exact_mean("confidence"), 10).alias("mean_confidence")
    )


def rule_summary(violations: DataFrame) -> DataFrame:
    """Violations by rule, version and severity, with totals."""
    per = violations.groupBy("rule", "severity", "spec_version").agg(F.count("*").alias("_n"))
    return per.rollup("rule", "severity", "spec_version").agg(
        F.sum("_n").alias("n"), F.grouping_id("rule", "severity", "spec_version").alias("level")
    )


def model_metrics(metrics: DataFrame) -> DataFrame:
    """Metric values are text; only those that are numbers take part."""
    num = lambda c: F.col(c).try_cast("double")
    width = num("upper_bound") - num("lower_bound")
    return metrics.groupBy("type", "slice").agg(
        F.count("*").alias("n"), F.count(num("value")).alias("n_numeric"),
        F.round(exact_mean(num("value")), 10).alias("mean_value"), F.round(exact_mean(width), 10).alias("mean_width"),
    )


def workflow_durations(tasks: DataFrame, by: str, start: str, end: str) -> DataFrame:
    secs = F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))
    return tasks.groupBy(by).agg(
        F.sum(secs).alias("total_seconds"), F.round(F.avg(secs), 6).alias("mean_seconds"), F.count("*").alias("n")
    )


def property_pivot(properties: DataFrame, names: list[str], with_refs: bool = False) -> DataFrame:
    """Selected property names as columns; a name may repeat, so each column
    is the list of values in document order, joined by ``|``. ``with_refs`` adds
    ``owner_ref`` out of the same rows, one row per owner: owners that share a
    pointer (copies of a document) share their values."""
    kept = properties.filter(F.col("name").isin(names))

    def values(n: str):
        entries = F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("position", "value"))))
        return F.array_join(F.transform(entries, lambda e: e["value"]), "|").alias(n)

    if not with_refs:
        return kept.groupBy("bom_id", "owner_pointer").agg(*[values(n) for n in names])
    # each owner has its first place once
    places = F.collect_list(F.struct("position", "owner_ref")).alias("_places")
    first = F.filter("_places", lambda p: p["position"] == F.array_min(F.transform("_places", lambda q: q["position"])))
    got = kept.groupBy("bom_id", "owner_pointer").agg(*[values(n) for n in names], places)
    return got.select("bom_id", "owner_pointer", *names, first.alias("_first")).select(
        "bom_id", "owner_pointer", *names, F.explode("_first").alias("_o")
    ).select("bom_id", "owner_pointer", F.col("_o.owner_ref").alias("owner_ref"), *names)


def noisy_or(methods: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """Combined confidence 1 - prod(1 - c); a certain method makes it 1."""
    c = F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0))
    log_sum = F.sum(F.when(c < 1.0, F.log1p(-c)))
    return methods.groupBy(*keys).agg(
        F.round(F.when(F.max(c) >= 1.0, 1.0).otherwise(1.0 - F.exp(F.coalesce(log_sum, F.lit(0.0)))), 6).alias("combined")
    )
