"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans.queries import QUERIES
from tidemark.session import build_session

HEADLINE = (
    "rollup_hour rollup_exact passthrough json_ingest typed_dims discovered_dims interval_rows filtered_count "
    "ingest_audit distinct_theta value_quantiles metric_count metric_gauge metric_timer compact_day reprocess "
    "segment_numbers chunk_summary rules_assign retained_rows broadcast_lookup json_equal json_includes json_drift "
    "spec_datasource compaction_docs content_hash sync_plan orphans orphan_sweep ranked merged_maps referenced_maps "
    "duplicates capacity_drift health rollout status_changes latest_state stream_rollup stream_changes"
).split()
WARM_RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(WARM_RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
