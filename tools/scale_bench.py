"""The headline jobs on copies of ``orders``: seconds, shuffle and spill.

usage: python tools/scale_bench.py [sf_dir] [copies ...]

Writes ``copies`` times the orders of ``sf_dir`` (new order keys, as many
files) to a fresh folder below the session's scratch folder, runs every
headline job once to warm up and once measured, and reads shuffle and spill
from Spark's event log.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from ecotally.queries import QUERIES  # noqa: E402
from ecotally.session import scratch_path  # noqa: E402


def copied(spark, sf_dir: str, copies: int) -> tuple[str, int]:
    """A folder with ``copies`` times the orders; its size in bytes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    top = orders.selectExpr("max(o_orderkey) + 1").first()[0]
    folder = scratch_path(spark, f"orders-x{copies}")
    many = orders.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))  # the copies are the point
    many = many.withColumn("o_orderkey", many["o_orderkey"] + top * many["copy"]).repartition(copies).drop("copy")
    many.write.parquet(f"{folder}/orders.parquet")
    local = folder.removeprefix("file:")
    return folder, sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(local) for f in fs if f.endswith(".parquet"))


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    sizes = [int(x) for x in sys.argv[2:]] or [1, 10, 40]
    log = tempfile.mkdtemp(prefix="ecotally-events-")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "32").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{log}")
             .config("spark.eventLog.compress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    rows = []
    for n in sizes:
        folder, size = copied(spark, sf_dir, n)
        for name in HEADLINE:
            for run in ("warm", "measured"):
                spark.sparkContext.setJobDescription(f"{n}|{name}|{run}")
                t = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                if run == "measured":
                    rows.append((n, size / 1e6, name, time.perf_counter() - t))
    spark.stop()
    of_stage: dict[int, str] = {}
    moved: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for d, _, fs in os.walk(log):
        for f in fs:
            for line in open(os.path.join(d, f)):
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    of_stage.update({s: e["Properties"].get("spark.job.description", "") for s in e["Stage IDs"]})
                elif e["Event"] == "SparkListenerTaskEnd" and (m := e.get("Task Metrics")):
                    x = moved[of_stage.get(e["Stage ID"], "")]
                    x[0] += m["Shuffle Write Metrics"]["Shuffle Bytes Written"] / 1e6
                    x[1] += m["Disk Bytes Spilled"] / 1e6
    print("| copies | input MB | query | seconds | shuffle MB | spill MB |\n| --- | --- | --- | --- | --- | --- |")
    for n, size, name, s in rows:
        shuffle, spill = moved[f"{n}|{name}|measured"]
        print(f"| {n} | {size:.1f} | `{name}` | {s:.2f} | {shuffle:.2f} | {spill:.2f} |")


if __name__ == "__main__":
    main()
