"""Headline queries: prints one JSON line with seconds per query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sumveil.catalog import all_entries
from sumveil.session import build_session

QUERIES = [
    "plain_polar", "plain_car", "plain_web",
    "private_polar", "private_car", "private_web",
    "plain_universe_any", "producer_window_sum", "committed_sum", "membership_diff", "prev_ts", "order_guard",
    "heac_window_sum", "release", "release_clique", "release_graph", "bench_compare", "graph_parameters",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or QUERIES
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    entries = all_entries()
    spark.read.parquet(f"{sf}/events.parquet").selectExpr("count(*)").collect()
    times = {}
    for name in wanted:
        t = time.time()
        entries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({
        "metric": "private stream aggregation, all headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": sf.rsplit("/sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
