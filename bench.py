"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boxmill import registry  # noqa: E402
from boxmill.session import build_session  # noqa: E402

HEADLINE = [
    "fetch_table",
    "partition",
    "partition_counts",
    "partition_deleted",
    "merge_new_wins",
    "merge_by_time",
    "merge_summary_by_time",
    "yolo_lines",
    "yolo_roundtrip",
    "label_text_boxes",
    "download_plan",
    "upload_plan",
    "push_shapes",
    "remap_labels",
    "camera_minutes",
    "camera_sequence",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", shuffle_partitions=int(cpus),
        spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.queries()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # start the JVM paths once, outside the measured queries
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        best = None
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds (best of runs)",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
