"""Headline jobs, one JSON line: BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from calorway.plans import catalog
from calorway.plans.shade_queries import horizon_table
from calorway.session import build_session

# horizons writes the table that the cost panel and the routes then read
HEADLINES = ["utci_curve", "crossing_candidates", "components", "horizons", "edge_cost_panel", "route_summary"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)), app="calorway-bench")
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {**catalog.QUERIES, "horizons": horizon_table}
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        jobs[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    samples = horizon_table(spark, sf).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")), "samples": samples,
        "horizon_samples_per_s": round(samples / seconds["horizons"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
