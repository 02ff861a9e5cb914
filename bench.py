"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores. Each query warms up on the smallest tables beside them, then runs
once timed, writing its whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from trailgraph.plans import catalog
from trailgraph.runtime import release
from trailgraph.session import get_spark

HEADLINE = [
    "graph_build", "call_edges", "js_imports",
    "impact_closure", "impact_direct_indirect", "callers_transitive", "simple_paths", "neighborhood_1hop", "in_degree_topk", "degree_undirected",
    "incremental_merge", "trust_reconcile", "node_dedup_merge", "edge_dedup_merge", "unique_name_resolution",
    "hotspots_topn", "ownership", "change_coupling", "file_coupling", "velocity_trend", "author_signals",
    "doc_freshness", "claim_verify", "relocated_citation", "gate_rule_lint", "gate_dead_exports", "secrets_scan",
    "retrieval_topk", "budget_greedy", "transcript_totals", "record_division", "flight_scope_audit",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = get_spark("bench", master=f"local[{cpus}]", spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    edges = None
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf
    for name in only.split(",") if only else HEADLINE:
        for folder in (warm, sf):
            t0 = time.perf_counter()
            df = catalog.QUERIES[name](spark, folder)
            if name == "graph_build":
                edges = df.agg({"n": "sum"}).first()[0]
            else:
                df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf")}
    if edges:
        out["graph_edges_per_sec"] = round(edges / times["graph_build"])
    print(json.dumps(out), flush=True)
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
