"""Headline-query timings.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query once cold (first run, includes JIT/plan warm-up) and
records the warm run (second execution) as the query's time.  Each query is
fully executed with a `noop` write (every row and column produced, nothing
collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text",
    "posts_by_source",
    "prepare_training_set",
    "convert_text",
    "pull_new_posts",
    "refresh_metrics",
    "audit_shape",
    "split_exact",
    "draw_coding_sample",
    "classification_report",
    "batched_f1",
    "repeated_handles",
    "encode_words",
    "wordpiece",
    "stream_collect",
    "train_and_evaluate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("THREADLINE_MASTER", f"local[{cpus}]")
    os.environ.setdefault("THREADLINE_SCAN_PARTITIONS", cpus)      # the test tables are single files
    os.environ.setdefault("THREADLINE_SHUFFLE_PARTITIONS", str(max(8, int(cpus))))
    from threadline.plans import catalog
    from threadline.session import build_session
    spark = build_session()
    catalog.load_all()
    times, cold = {}, {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        runs = []
        for _ in range(2):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        cold[name], times[name] = round(runs[0], 3), round(runs[1], 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold": cold, "sf": sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
