"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from petrel.plans.queries import queries
from petrel.session import session

HEADLINE = [
    "relation_support", "relation_support_of_log", "relations_min_support", "clean_normalise", "clean_drop_counts", "dedup_first_wins", "expand_multi_object",
    "alias_projection", "timestamp_cascade", "ocel2_join", "interaction_edges", "metrics_all_by_model", "graph_diameter", "validation_findings", "comparison_rank",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    known["relation_support"](spark, sf_dir).collect()  # starts the engine
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
