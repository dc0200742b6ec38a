"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.
Each query runs to a no-op sink, after one warm-up query for the session."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bomspark.plans import QUERIES  # noqa: E402
from bomspark.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_open_risk latest_bom inventory_counts distinct_packages license_policy match_vulnerabilities vulnerability_status "
    "apply_vex resolve_bom_links identity_by_hash bom_diff component_timeline merge_boms open_exposure top_k_per_bom rank_ratings "
    "rule_ref_unique rule_ref_dangling document_verdict transitive_dependencies dependency_cycles alias_groups flatten_components "
    "explode_licenses explode_dependencies explode_vulnerabilities_affects write_bom_json observe_licenses stream_severity_tumbling "
    "stream_bom_vuln_join"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["severity_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "bom_query_suite_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
