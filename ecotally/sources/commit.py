"""Sets of reports that appear all or none.

A job writes its reports into a version folder of its own,
``<out>/<version>/<report>``, and publishes the version by one small file,
``<out>/_reports.json``, that is written beside and renamed into place.
Until then readers find the set before; a job that fails leaves it as it is.
The version before the published one is kept for readers that are still at it,
older ones that a manifest named are removed.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_reports.json"


def new_version() -> str:
    return f"v{time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"


def version_path(out: str, version: str, report: str) -> str:
    return f"{out.rstrip('/')}/{version}/{report}"


def _files(spark: SparkSession, path: str):
    """Hadoop's file context and path class: any store that Spark writes to."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    return hadoop_path(path).getFileSystem(conf), hadoop_path


def manifest(spark: SparkSession, out: str) -> dict | None:
    """The published manifest: version, reports, format, and the version before."""
    fs, hadoop_path = _files(spark, out)
    path = hadoop_path(f"{out.rstrip('/')}/{MANIFEST}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, out: str, version: str, reports: list[str], fmt: str) -> None:
    """Make ``version`` the set that readers find."""
    fs, hadoop_path = _files(spark, out)
    old = manifest(spark, out)
    named = {"version": version, "reports": reports, "format": fmt, "before": old and old["version"]}
    beside, path = hadoop_path(f"{out.rstrip('/')}/_{version}.json"), hadoop_path(f"{out.rstrip('/')}/{MANIFEST}")
    stream = fs.create(beside, True)
    stream.write(bytearray(json.dumps(named).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(),
                                                                         spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    rename = spark.sparkContext._gateway.new_array(options, 1)
    rename[0] = options.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(path), rename)
    if old and old["before"]:
        fs.delete(hadoop_path(f"{out.rstrip('/')}/{old['before']}"), True)


def report_paths(spark: SparkSession, out: str) -> dict[str, str]:
    """Folder of each published report of ``out``."""
    m = manifest(spark, out)
    if m is None:
        raise FileNotFoundError(f"no published reports in {out}")
    return {name: version_path(out, m["version"], name) for name in m["reports"]}


def read_reports(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The published reports of ``out``."""
    paths = report_paths(spark, out)
    if manifest(spark, out)["format"] == "parquet":
        return {name: spark.read.parquet(p) for name, p in paths.items()}
    return {name: spark.read.option("header", True).option("nullValue", "NA").option("escape", '"').csv(p) for name, p in paths.items()}
