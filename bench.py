"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and cores. Every run of a query starts from the tables; nothing is
kept between runs. The value is the sum of the queries' medians.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.all_queries import QUERIES
from checks.compare import session

HEADLINE = [
    "d2_segments",
    "d3_drop_speed_outliers",
    "g1_session_windows",
    "g3_assign_route",
    "f4_crossings",
    "g4_gap_summary",
    "f5_asof_last",
    "g10_proximity_counts",
    "k1_kruskal_wallis",
    "k5_levene_price",
    "k7_mantel",
    "x5_stops",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["g4_gap_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start workers, warm up
    taken = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        taken[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
