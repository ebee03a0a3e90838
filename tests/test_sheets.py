"""Sheets below title lines, of any size."""

from types import SimpleNamespace

import pytest

from ecotally import queries
from ecotally.session import scratch_path
from ecotally.sources import files


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_sheet_of_many_blocks_with_line_breaks(spark, small_blocks):
    rows = [(f"k{k:04}", None if k % 11 == 0 else f'say "{k}"\n\nthen, {k}' if k % 4 == 0 else "x" * (k % 50 + 1), k / 7) for k in range(400)]
    path = scratch_path(spark, "blocks")
    files.write_sheet(spark.createDataFrame(rows, "k string, note string, v double").coalesce(2), path, ["One title", 'A 5" title'], ["k"])
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    back = files.read_sheet(spark, path, skip=2, types={"V": "double"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")  # what is read does not depend on later settings
    assert back.columns == ["k", "note", "v"] and sorted(map(tuple, back.collect())) == rows


def test_sheet_without_line_breaks(spark, small_blocks):
    rows = [(f"k{k:04}", "y" * (k % 30 + 1)) for k in range(300)]
    path = scratch_path(spark, "plain")
    files.write_sheet(spark.createDataFrame(rows, "k string, note string"), path, ["t"], ["k"])
    assert sorted(map(tuple, files.read_sheet(spark, path, skip=1).collect())) == rows


def write(spark, path, *texts):
    for k, t in enumerate(texts):
        spark.createDataFrame([(t,)], "v string").coalesce(1).write.mode("append").text(path)
    return path


def test_headers_must_be_the_same(spark):
    same = write(spark, scratch_path(spark, "same"), "t\na,b\n1,2\n", "u\na,b\n\n3,4\n")
    assert sorted(map(tuple, files.read_sheet(spark, same, skip=1).collect())) == [("1", "2"), ("3", "4")]
    with pytest.raises(ValueError, match="different headers"):
        files.read_sheet(spark, write(spark, scratch_path(spark, "differ"), "t\na,b\n1,2\n", "t\na,c\n3,4\n"), skip=1)
    with pytest.raises(ValueError, match="no header line 4"):
        files.read_sheet(spark, write(spark, scratch_path(spark, "short"), "t\na,b\n"), skip=3)
    with pytest.raises(ValueError, match="has no end"):
        files.read_sheet(spark, write(spark, scratch_path(spark, "open"), 't\na,b\n1,"2\n3,4'), skip=1)


@pytest.mark.parametrize("width, least, most", [(20, 3, 60), (400, 200, 320)])
def test_blocks_of_the_sheet_query_do_not_multiply(spark, monkeypatch, width, least, most):
    """Small sheets are read by several tasks, larger ones not by ever more."""
    blocks = []

    def seen(session, path, **_):
        blocks.append(session.read.text(path).rdd.getNumPartitions())

    monkeypatch.setattr(files, "read_sheet", seen)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    queries.src_sheet_in_blocks(SimpleNamespace(spark=spark, raw=spark.range(20_000).selectExpr("id AS FID", f"repeat('x', {width}) AS SITEMC_S1")))
    assert least <= blocks[0] <= most and spark.conf.get("spark.sql.files.maxPartitionBytes") == old
