"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median counts. The shared processed table is written
before the clock starts, as the batch flow does; ``clean_incidents`` times the cleaning itself.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pointweave.plans.catalog import QUERIES, processed  # noqa: E402
from pointweave.session import local_session  # noqa: E402

HEADLINE = (
    "clean_incidents", "hexbins_by_category", "summary_by_offense", "summary_of_prices", "point_in_polygon",
    "range_join", "count_within", "knn_join", "quadrat_counts", "yearly_trend", "correlation", "queen_edges",
    "getis_ord_z", "global_moran", "kde_surface", "ripleys_k", "dbscan_labels", "layer_heat",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=cores, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    processed(spark, sf_dir)
    timings = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, median of warm runs", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cores,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
