"""Benchmark the headline jobs.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]``: two warm-up passes over all jobs, then
``$BENCH_REPS`` (default 5) interleaved passes; each job's time is the median
of its runs, each written in full to the ``noop`` sink (plan building
included).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ecotally.queries import QUERIES  # noqa: E402
from ecotally.session import build_session  # noqa: E402

HEADLINE = ["deciles_long", "eu_summary_by_zone", "bhc_summary", "mc_report", "whr_rate", "parcel_report"]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "5"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app="ecotally-bench")
    for _ in range(2):  # warm-up: every job twice, so the JVM has compiled their code paths
        for name in names:
            run_once(spark, name, sf_dir)
    runs = {name: [] for name in names}
    for _ in range(reps):  # interleaved, so drift of the machine spreads evenly over the jobs
        for name in names:
            runs[name].append(run_once(spark, name, sf_dir))
    times = {name: round(statistics.median(ts), 4) for name, ts in runs.items()}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "reps": reps,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
