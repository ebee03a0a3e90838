"""Session helpers: a tuned local session for tests/bench, and the shared
scratch folder (``spark.checkpoint.dir``) for anything written mid-job."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "ecotally") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ECOTALLY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(input_bytes: int, executors: int, cores_per_executor: int,
                     target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of polygon files.

    * scan splits of 256 MB (polygon rows are narrow after column pruning);
    * initial shuffle partitions: enough for the one data-sized shuffle (the
      per-polygon ratings table, ~1/4 of the scanned bytes) at
      ``target_partition_bytes`` each, and at least 3 waves of all cores.
      AQE then coalesces the small post-aggregate shuffles and splits skewed
      partitions of shuffled joins.
    """
    cores = executors * cores_per_executor
    shuffle = max(3 * cores, (input_bytes // 4) // target_partition_bytes)
    return {
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    }


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from the session.  A local session that names none (tests) gets a
    folder of its own, registered so that later calls and ``checkpoint()`` use
    the same place; on a cluster the setting is required, because executors
    don't share machine-local folders.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ecotally-ckpt-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
