"""Time the headline queries and print one JSON line.

Each query runs to completion into a no-op sink. Tables that queries share (edges, entities,
chains, rules) are built and timed first under ``build_*`` names, once, as a deployment would.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from fundtrail.plans import catalog
from fundtrail.plans.domain import Tables

HEADLINE = (
    "rule_hit_counts run_rules fan_out mixer_adjacent leakage_report khop_neighbourhood "
    "subgraph_stats case_summary batch_verdicts signal_overlap cluster_summary attribute_clusters sink_cluster_report "
    "convergence utxo_clusters change_address_links bounded_expansion live_hops scan_tx_json_esplora record_constraints "
    "address_quality train_and_evaluate mempool_alerts alert_history alert_state"
).split()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run = catalog.queries()
    t = Tables(spark, sf_dir)
    t.read("lineitem").groupBy("l_suppkey").count().collect()  # start the JVM's code paths
    times = {
        "build_edges": timed(lambda: t.raw_edges), "build_index": timed(lambda: t.index), "build_peel": timed(lambda: t.peel),
        "build_rules": timed(lambda: t.wallet_rules), "build_entities": timed(lambda: t.entities), "build_split": timed(lambda: t.split),
        "build_io": timed(lambda: t.io), "build_tx_index": timed(lambda: t.tx_index),
    }
    for name in names:
        times[name] = timed(lambda: run[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
