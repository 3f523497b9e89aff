"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from ledgerscope.plans import registry
from ledgerscope.plans.bench import Bench
from ledgerscope.session import build_session

HEADLINE = [
    "n11_address_rollup", "n15_clean_transactions", "n24_decompose_outputs", "q01_q15_validation_report",
    "f08_f13_address_history", "f14_f17_temporal", "f20_f21_network_features", "f24_feature_matrix", "f26_chronological_split",
    "g04_degrees", "g05_g08_clusters", "g07_cluster_history", "g09_component_growth", "g10_g12_neighbour_history",
    "g13_degree_distributions", "g20_payment_edges", "g23_address_neighbourhood", "t01_filtered_listing", "t10_address_listing",
    "w01_endpoints", "w05_w06_ip_enrichment", "a05_a06_alerts", "m01_robust_scaling", "m06_roc_and_pr_auc", "m08_threshold_sweep",
    "m18_row_explanations", "e02_column_profile", "d01_behaviour_top", "st1_burst_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")
    plans, times = registry.plans(), {}
    start = time.time()
    bench = Bench(spark, folder)
    times["ingest"] = round(time.time() - start, 3)
    # artifacts that reporting queries read, built once and timed apart from them
    for name in ("addresses", "timeline", "features", "edges", "nodes", "split", "graph_features", "modelling"):
        start = time.time()
        getattr(bench, name)
        times[f"build_{name}"] = round(time.time() - start, 3)
    for name in wanted:
        start = time.time()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
