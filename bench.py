"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS choose data and cores; BENCH_KEYS=all times every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metasift.plans import load_all  # noqa: E402
from metasift.session import local_session  # noqa: E402

HEADLINE = [
    "analyze_payloads", "detect_source", "find_key_precedence", "cfg_snowflake", "dq_config",
    "parse_urn", "lineage_upstream", "impact_closure", "first_write_wins", "first_n_per_group", "entity_search",
    "flatten_paths_indexed", "diff_flat", "diff_tree", "reconcile_documents", "merge_three_way",
    "dq_scorecard", "dq_unique", "dq_referential", "dq_actions_split", "cdc_apply", "ingest_incremental", "write_partitioned",
    "order_activities", "flow_graph", "flow_text", "capability_matrix", "structural_dedup",
    "link_upstream_theta", "assemble_asset_links", "storage_rollup", "code_findings", "merge_job_layers", "job_parameters",
    "tumbling_window_agg", "stream_dq_quarantine",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    keys = list(entries) if os.environ.get("BENCH_KEYS") == "all" else HEADLINE
    entries["row_filter_where"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in keys:
        start = time.perf_counter()
        entries[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
