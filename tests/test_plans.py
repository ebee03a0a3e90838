"""Plan shape: the physical plans the jobs are meant to have."""

import re

import pytest

from helpers import SF_SMALL
from ecotally.operators.lookup import lookup
from ecotally.session import shared_dir

from ecotally.queries import QUERIES as Q


def plan(df, capsys, executed=False) -> str:
    if executed:
        df.collect()
    df.explain()
    return capsys.readouterr().out


def no_python(p: str) -> bool:
    return not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF|FlatMapGroupsInPandas|MapInPandas", p)


def test_habitat_summary_one_wide_shuffle_then_broadcast_lookups(spark, capsys):
    p = plan(Q["bhc_summary"](spark, SF_SMALL), capsys)
    assert p.count("Exchange hashpartitioning") == 2  # units, then the (small) category roll-up
    assert p.count("BroadcastHashJoin") == 2 and p.count("LocalTableScan") == 2
    assert "SortMergeJoin" not in p
    # the scan reads only the three order columns the job needs
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>", plan_formatted(
        Q["bhc_summary"](spark, SF_SMALL), capsys))
    assert no_python(p)


def plan_formatted(df, capsys) -> str:
    df.explain("formatted")
    return capsys.readouterr().out


def test_rating_join_does_not_shuffle_components(spark, capsys):
    p = plan(Q["whr_rate"](spark, SF_SMALL), capsys)
    assert "Exchange hashpartitioning" not in p and "rangepartitioning" not in p
    assert "BroadcastHashJoin" in p and no_python(p)


def test_reshaping_is_narrow(spark, capsys):
    p = plan(Q["deciles_long"](spark, SF_SMALL), capsys)
    assert "Exchange" not in p and "Generate inline" in p
    # the empty-component filter is a plain filter, not a lambda in the array
    assert "lambdafunction" not in p


def test_parcel_report_with_known_classes_scans_once(spark, capsys):
    from ecotally.plans import parcels
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    df = parcels.parcel_report(i.polygons, i.map_codes, i.categories, classes=["Footprint", "Not footprint"],
                               map_rows=10, cat_rows=19)
    p = plan(df, capsys, executed=True)
    final = p.split("== Initial Plan ==")[0] if "== Initial Plan ==" in p else p
    assert "isFinalPlan=true" in final
    assert "ReusedExchange" in final
    assert final.count("FileScan parquet") == 1


def test_parcel_report_discovering_classes_scans_once_for_the_report(spark, capsys):
    p = plan(Q["parcel_report"](spark, SF_SMALL), capsys, executed=True)
    final = p.split("== Initial Plan ==")[0] if "== Initial Plan ==" in p else p
    assert "ReusedExchange" in final and final.count("FileScan parquet") == 1


def test_property_filter_runs_on_the_scan_before_reshaping(spark, capsys):
    # the fixture derives Location with a CASE, which parquet cannot take
    # as a pushed filter; the filter still sits directly on the scan, below
    # the Generate, so only the property's polygons are reshaped
    p = plan_formatted(Q["bhc_property"](spark, SF_SMALL), capsys)
    m = re.search(r"\(2\) Filter\s*\nInput[^\n]*\nCondition : ([^\n]*)", p)
    assert m and "o_orderstatus" in m.group(1)
    assert re.search(r"\(3\) (Project|Generate)", p)


def test_lookup_broadcasts_only_under_the_bound(spark, capsys):
    big = spark.range(1000).selectExpr("CAST(id AS STRING) AS k", "id AS v")
    small = spark.range(5).selectExpr("CAST(id AS STRING) AS k", "id * 2 AS w")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        under = plan(lookup(big, small, ["k"], max_rows=10), capsys)
        over = plan(lookup(big, small, ["k"], max_rows=3), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", old_aqe)
    assert "BroadcastHashJoin" in under
    assert "BroadcastHashJoin" not in over and "SortMergeJoin" in over


def test_scratch_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    d = shared_dir(spark)
    if configured:
        assert d == configured.rstrip("/")
    assert d


@pytest.mark.parametrize("name", sorted(Q))
def test_no_python_in_any_plan(spark, capsys, name):
    assert no_python(plan(Q[name](spark, SF_SMALL), capsys))


def test_no_python_in_what_the_file_queries_write(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    seen = []
    for kind in ("csv", "text"):
        def write(self, path, *a, f=getattr(DataFrameWriter, kind), **kw):
            seen.append(self._df._jdf.queryExecution().executedPlan().toString())
            return f(self, path, *a, **kw)

        monkeypatch.setattr(DataFrameWriter, kind, write)
    for name in ("src_typed_csv", "snk_csv_roundtrip", "src_header_offset"):
        Q[name](spark, SF_SMALL)
    assert len(seen) == 3 and all(no_python(p) for p in seen)


@pytest.mark.parametrize("name", ["rating_area_all", "rating_area_first", "whr_unmatched"])
def test_area_reports_join_ratings_after_the_first_exchange(spark, capsys, name):
    p = plan(Q[name](spark, SF_SMALL), capsys)
    below = p[p.rindex("Exchange hashpartitioning"):]
    assert "Join" in p and "Join" not in below


@pytest.mark.parametrize("name, scans", [("qa_component_crosstabs", 1), ("qa_pack", 1), ("qa_rating_conservation", 1)])
def test_qa_scans_and_builds_without_jobs(spark, capsys, name, scans):
    from ecotally.queries import inputs

    inputs(spark, SF_SMALL)  # reading a file's schema is a job
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        df = Q[name](spark, SF_SMALL)
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    p = plan(df, capsys, executed=True).split("== Initial Plan ==")[0]
    assert p.count("FileScan parquet") <= scans


def test_few_wide_rows_are_not_broadcast(spark, capsys):
    big = spark.range(1000).selectExpr("CAST(id AS STRING) AS k", "id AS v")
    wide = spark.range(20).selectExpr("CAST(id AS STRING) AS k", "repeat('x', 100000) AS w")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        over = plan(lookup(big, wide, ["k"], table_rows=20, max_bytes=1 << 20), capsys)
        under = plan(lookup(big, wide, ["k"], table_rows=20), capsys)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" not in over and "BroadcastHashJoin" in under


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    def session(master, path=None):
        sc = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": path} if path else {}, getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=sc)

    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs:///x/")) == "hdfs:///x"


def test_shuffled_lookup_is_salted_without_aqe_skew_splitting(spark, capsys):
    # a hot key: 90% of the rows share one key
    big = spark.range(2000).selectExpr("CASE WHEN id % 10 = 0 THEN CAST(id AS STRING) ELSE 'hot' END AS k", "id AS v")
    table = spark.range(1000).selectExpr("CAST(id * 10 AS STRING) AS k", "id AS w").union(
        spark.createDataFrame([("hot", -1)], "k string, w bigint"))
    want = sorted(tuple(r) for r in lookup(big, table, ["k"], table_rows=1001).collect())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        salted = lookup(big, table, ["k"], max_rows=10)
        p = plan(salted, capsys)
        got = sorted(tuple(r) for r in salted.collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in p and "__salt_l" in p and "explode(" in p and "xxhash64" in p
    assert got == want and len(got) == 2000


def test_polygons_bucketed_by_fid_make_the_per_polygon_report_shuffle_free(spark, capsys):
    from ecotally.plans import ratings
    from ecotally.queries import inputs
    from ecotally.session import scratch_path

    i = inputs(spark, SF_SMALL)
    name = "polygons_by_fid_" + scratch_path(spark, "t").rsplit("-", 1)[-1][:8]
    i.polygons.write.bucketBy(8, "fid").sortBy("fid").option("path", scratch_path(spark, "bucketed")).saveAsTable(name)
    wide = ratings.rating_wide(ratings.rate(ratings.rating_components(spark.table(name)), i.ratings, rating_rows=6))
    p = plan(wide, capsys)
    assert "Exchange hashpartitioning" not in p and "rangepartitioning" not in p
    assert wide.count() == Q["whr_wide"](spark, SF_SMALL).count()


def test_per_polygon_ratings_shuffle_no_polygon(spark, capsys):
    lines = plan(Q["whr_wide"](spark, SF_SMALL), capsys).splitlines()
    assert not [ln for ln in lines if "Exchange" in ln and "fid" in ln] and sum("FileScan" in ln for ln in lines) == 1
    some = plan(Q["whr_wide_repeated"](spark, SF_SMALL), capsys)
    assert "hashpartitioning(fid" in some and "left_anti".replace("left_", "Left").replace("anti", "Anti") in some


def test_duplicates_of_clean_data_shuffle_no_polygon(spark, capsys):
    from ecotally.plans import qa
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    assert "Exchange" not in plan(qa.duplicate_rated(i.polygons, i.ratings, "c"), capsys)


def test_planned_size_of_files_proves_nothing(spark):
    from ecotally.operators.lookup import fits_broadcast
    from ecotally.session import scratch_path

    path = scratch_path(spark, "equal-rows")
    spark.range(0, 3_000_000, numPartitions=4).selectExpr("1 AS k", "'same' AS v").write.parquet(path)
    rows = spark.read.parquet(path)
    assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20  # what the planner sees
    assert not fits_broadcast(rows) and not fits_broadcast(rows, table_rows=10)
    assert fits_broadcast(spark.createDataFrame([(1, "a")], "k int, v string"))


def test_area_conservation_scans_once(spark, capsys):
    p = plan(Q["qa_area_conservation"](spark, SF_SMALL), capsys, executed=True)
    final = p.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and final.count("ReusedExchange [bec_variant") == 3


def test_parcel_join_needs_no_extra_exchange_when_not_broadcast(spark, capsys):
    from ecotally.plans import parcels
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = parcels.parcel_report(i.polygons, i.map_codes, i.categories, classes=["Footprint", "Not footprint"],
                                   map_rows=10, cat_rows=19)
        p = plan(df, capsys)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin [__pkey" in p
    # one unit shuffle (reused) + one per per-parcel aggregate; nothing added for the join
    exchanges = [ln for ln in p.splitlines() if "Exchange hashpartitioning" in ln and "ReusedExchange" not in ln]
    assert len(exchanges) == 3 and "ReusedExchange" in p
    assert p.count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["eu_summary_by_zone", "bhc_summary", "mc_report", "parcel_report", "whr_wide",
                                  "qa_frequencies", "rating_area_all"])
def test_every_hash_exchange_is_fed_by_a_partial_aggregate(spark, capsys, name):
    # a hot key (one unit / zone / parcel with a third of all rows) then costs
    # one row per map task on the wire, not a third of the data in one task
    lines = plan(Q[name](spark, SF_SMALL), capsys).splitlines()
    hash_exchanges = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln and "Reused" not in ln]
    assert hash_exchanges
    for i in hash_exchanges:
        below = lines[i + 1]
        assert re.search(r"(HashAggregate|SortAggregate)\(keys?=\[[^\]]*\], functions=\[(partial_|\])", below), below
