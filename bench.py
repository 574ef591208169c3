"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1), local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no driver collect);
the reported time per query is the median of $BENCH_REPEATS runs.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobsift.catalog import QUERIES, load_all  # noqa: E402
from jobsift.session import build_session  # noqa: E402

HEADLINE = [
    "r6_recommend_initial",
    "k2_skill_neighbours",
    "k1_dense_top_k",
    "v7_pair_rate",
    "v11_threshold_sweep",
    "a12_action_type_means",
    "n3_name_swap",
    "w8_session_fold",
    "i6_html_to_text",
    "m7_hard_negatives",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    load_all()
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times, rows = {}, {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        runs = []
        for _ in range(repeats):
            t0 = time.time()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
        rows[name] = QUERIES[name](spark, sf_dir).count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": int(cpus), "repeats": repeats}))


if __name__ == "__main__":
    main()
