"""File-to-report jobs give the registered queries' results."""

from helpers import SF_SMALL
from ecotally import jobs
from ecotally.session import scratch_path
from ecotally.sources import commit, files
from ecotally.sources.fixture import load_fixture

from ecotally.queries import QUERIES as Q


def _sorted(df, cols):
    return sorted(tuple("" if r[c] is None else (float(r[c]) if c in ("total_area", "area") else str(r[c]))
                        for c in cols) for r in df.collect())


def _close(a, b):
    """Same rows; numbers equal to the 6 decimals a CSV report holds."""
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0]
        assert (x[1] == y[1]) if "" in (x[1], y[1]) else abs(x[1] - y[1]) <= 1e-6


def test_habitat_and_rate_jobs_from_files(spark):
    fx = load_fixture(spark, SF_SMALL)
    base = scratch_path(spark, "jobs")
    # polygons as a CSV export (area named Shape_Area), lookups as sheets with title lines
    fx.polygons.withColumnRenamed("AREA", "Shape_Area").write.option("header", True).option(
        "nullValue", "NA").csv(f"{base}/polygons")
    mc = fx.map_codes.withColumnsRenamed({"bec_variant": "BEC Variant", "map_code": "Map Code",
                                          "site_series": "Site Series", "site_series_name": "Site Series Name"})
    files.write_sheet(mc, f"{base}/map_codes", ["Map codes"], sort_by=["Sort"])
    files.write_sheet(fx.habitat_categories.withColumnRenamed("ecosystem_unit", "Ecosystem Unit"),
                      f"{base}/categories", ["EUs", "with", "categories"])
    # a CSV cell can't hold an empty text that is not missing; such keys match no uncleaned modifier anyway
    files.write_csv(fx.ratings.filter("STRCT_M IS NULL OR STRCT_M <> ''"), f"{base}/ratings")

    common = ["--polygons", f"{base}/polygons", "--polygons-format", "csv", "--spelling", "cem_shape_area"]
    sheets = ["--map-codes", f"{base}/map_codes", "--map-codes-skip", "1",
              "--categories", f"{base}/categories", "--categories-skip", "3"]
    jobs.main(["habitat", *common, *sheets, "--out", f"{base}/habitat"], spark=spark)
    got = files.read_typed_csv(spark, commit.report_paths(spark, f"{base}/habitat")["habitat_summary"], {"Total_area": "double"})
    assert got.columns == ["BHC20", "Total_area"]
    got = got.toDF("bhc20", "total_area")
    _close(_sorted(got, ["bhc20", "total_area"]), _sorted(Q["bhc_summary"](spark, SF_SMALL), ["bhc20", "total_area"]))

    jobs.main(["zones", *common, *sheets, "--out", f"{base}/zones"], spark=spark)
    got = files.read_typed_csv(spark, commit.report_paths(spark, f"{base}/zones")["map_codes_by_zone"], {"Sort": "int"})
    assert got.columns == ["Sort", "BEC Variant", "Ecosystem", "Site Series", "Site Series Name", "Type", "Dam", "Reservoir",
                           "TL", "Hwy 29", "Road", "Quarry", "Erosion Impact"]
    zones = files.read_typed_csv(spark, commit.report_paths(spark, f"{base}/zones")["eu_by_zone"])
    assert zones.columns == ["PAZ", "BEC Variant", "Ecosystem", "Site Series Name", "Type", "STRCT", "structural_class", "Total_area"]
    after = files.read_typed_csv(spark, commit.report_paths(spark, f"{base}/zones")["eu_after"])
    assert after.columns == ["Type", "structural_class_after", "Total_area"]

    jobs.main(["parcels", *common, *sheets, "--out", f"{base}/parcels"], spark=spark)
    split = files.read_typed_csv(spark, commit.report_paths(spark, f"{base}/parcels")["parcel_area"])
    assert split.columns == ["ParcelID_t", "Footprint", "Not footprint", "parcel_area"]
    header = spark.read.text(commit.report_paths(spark, f"{base}/parcels")["parcel_habitat"]).filter("value LIKE 'ParcelID%'").first()[0].split(",")
    assert header[:3] == ["ParcelID_t", "CMF", "CYF"] and header[-4:] == ["NA", "Footprint", "Not footprint", "parcel_area"]
    assert got.count() == Q["mc_report"](spark, SF_SMALL).count()

    jobs.main(["rate", *common, "--ratings", f"{base}/ratings", "--out", f"{base}/rate"], spark=spark)
    got = files.read_typed_csv(spark, commit.report_paths(spark, f"{base}/rate")["area_by_rating"], {"area_tot": "double"})
    want = Q["rating_area_all"](spark, SF_SMALL)
    got = got.withColumnRenamed("BSEOW_LI", "rating")
    _close(_sorted(got.withColumnRenamed("area_tot", "area"), ["rating", "area"]),
           _sorted(want.withColumnRenamed("area_tot", "area"), ["rating", "area"]))


def test_rating_job_uses_ten_parts_whatever_the_columns(spark):
    """Site series columns in the polygons and the sheet don't change the rating job."""
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    assert "site_1" in i.polygons.columns and "SITE_S" in i.ratings.columns
    out = jobs.rate_job(i.polygons, i.ratings)
    without = jobs.rate_job(i.polygons.drop("site_1", "site_2", "site_3"), i.ratings.drop("SITE_S"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(out["rated"]) == rows(without["rated"]) == rows(Q["whr_rate"](spark, SF_SMALL))
    assert out["rated"].filter("rating IS NOT NULL").count() > 0
    out["ecosystem_list"].collect()
    totals = out["control_totals"]().collect()  # of the rows that the two reports above have written
    want = Q["qa_rating_conservation"](spark, SF_SMALL).collect()
    assert sorted(map(str, totals)) == sorted(map(str, want)) and len({r["total_area"] for r in totals}) == 1
    whi = jobs.whi_job(i.polygons, i.ratings, i.map_codes)["first_component_rating"]
    assert rows(whi) == rows(Q["whi_first_component"](spark, SF_SMALL))
    jobs.release_shared()


def test_every_job_runs(spark):
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    outs = {
        **jobs.zones_job(i.polygons, i.map_codes),
        **{f"h_{k}": v for k, v in jobs.habitat_job(i.polygons, i.map_codes, i.categories).items()},
        **{f"p_{k}": v for k, v in jobs.property_job(i.polygons, i.map_codes, i.categories, negate=True).items()},
        **{f"x_{k}": v for k, v in jobs.crosswalk_job(i.polygons, i.crosswalk, i.map_codes, i.categories).items()},
        **jobs.parcels_job(i.polygons, i.map_codes, i.categories),
        **jobs.rate_job(i.polygons, i.ratings),
        **jobs.whi_job(i.polygons, i.ratings, i.map_codes),
        **jobs.qa_job(i.polygons),
    }
    counts = {k: v.count() for k, v in outs.items() if k != "control_totals"}
    assert outs["control_totals"]().count() == 3
    assert all(counts.values()), counts
    # the spatial job keeps empty components: one EU group with no ecosystem
    assert outs["eu_summary"].filter("ecosystem IS NULL").count() > 0
    jobs.release_shared()


def test_reports_of_a_job_share_one_scan(spark, capsys):
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    reports = jobs.zones_job(i.polygons, i.map_codes)
    reports["eu_by_zone"].write.format("noop").mode("overwrite").save()
    reports["eu_after"].explain()
    p = capsys.readouterr().out
    assert "InMemoryTableScan" in p  # (the FileScan printed under it is the cached lineage)
    jobs.write_reports({}, scratch_path(spark, "none"))  # releases the job's shared aggregate
    assert not jobs._SHARED


def scans(df, capsys):
    df.explain()
    return capsys.readouterr().out.count("FileScan parquet")


def test_qa_job_scans_once(spark, capsys):
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    reports = jobs.qa_job(i.polygons)
    packed = jobs._SHARED[-1]
    assert scans(packed, capsys) == 1
    for df in reports.values():
        df.explain()
        plan = capsys.readouterr().out
        assert plan.count("InMemoryTableScan") >= 1
        # below the kept aggregate the printed lineage has the scan; above it nothing reads the polygons
        assert all("InMemoryRelation" in part for part in plan.split("FileScan parquet")[:-1])
    jobs.release_shared()


def test_reports_appear_all_or_none(spark):
    import pytest

    out = scratch_path(spark, "set")
    a = spark.range(3).selectExpr("id AS fid", "'x' AS rating")
    jobs.write_reports({"one": a, "two": a}, out)
    assert {k: v.count() for k, v in commit.read_reports(spark, out).items()} == {"one": 3, "two": 3}
    assert commit.read_reports(spark, out)["one"].columns == ["FID", "BSEOW_LI"]

    def broken():
        raise RuntimeError("third report")

    with pytest.raises(RuntimeError, match="third report"):
        jobs.write_reports({"one": a.limit(1), "two": a.limit(1), "three": broken}, out)
    assert {k: v.count() for k, v in commit.read_reports(spark, out).items()} == {"one": 3, "two": 3}
    before = commit.manifest(spark, out)["version"]
    for n in (2, 1):
        jobs.write_reports({"one": a.limit(n)}, out, fmt="parquet")
        assert {k: v.count() for k, v in commit.read_reports(spark, out).items()} == {"one": n}
    assert commit.manifest(spark, out)["before"] != before
    with pytest.raises(FileNotFoundError):
        commit.read_reports(spark, out + "-none")


def test_rating_job_takes_totals_by_the_revised_sheet(spark):
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    out = jobs.rate_job(i.polygons, i.ratings, revised=i.ratings_revised)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(out["area_by_rating"]) == rows(Q["rating_area_revised"](spark, SF_SMALL))
    assert rows(out["rating_by_polygon"]) == rows(Q["whr_wide"](spark, SF_SMALL))
    jobs.release_shared()


def test_warnings_of_the_reader(spark, capsys):
    path = scratch_path(spark, "bad") + ".csv"
    spark.createDataFrame([("FID,SDEC_1,Shape_Area",), ("1,ten,5.5",), ("2,10,big",), ("3,,",)], "v string").coalesce(1).write.text(path)
    seen = files.ReadReport()
    df = files.read_typed_csv(spark, path, {"SDEC_1": "int", "Shape_Area": "double", "SDEC_2": "int"}, seen)
    assert [tuple(r) for r in df.collect()] == [("1", None, 5.5), ("2", 10, None), ("3", None, None)]
    assert seen.rows == 3 and seen.bad_cells == {"SDEC_1": 1, "Shape_Area": 1} and seen.absent == ["sdec_2"]
    assert len(seen.warnings()) == 3


def test_cluster_settings_scale_with_input():
    from ecotally.session import cluster_settings

    small = cluster_settings(10 << 30, executors=10, cores_per_executor=4)
    big = cluster_settings(100 << 40, executors=1000, cores_per_executor=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 120  # 3 waves of 40 cores
    # 100 TB: a quarter of the input in 128 MB partitions
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // 4 // (128 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_qa_job_tables(spark):
    from ecotally.queries import inputs

    i = inputs(spark, SF_SMALL)
    out = jobs.qa_job(i.polygons)
    tabs = {}
    for r in out["component_crosstabs"].collect():
        tabs.setdefault(r["table"], set()).add((r["row"], r["col"]))
    # map code x seral for component 1; a pair whose second column is all missing counts no rows
    assert {c for _, c in tabs["sitemc_1_x_seral_1"]} == {"as"} and "strct_3_x_strct_m_3" in tabs
    assert "strct_2_x_strct_m_2" not in tabs and "sitemc_3_x_seral_3" not in tabs
    freq = {(r["column"], r["value"]): r["n"] for r in out["frequencies"].collect()}
    assert ("site_ma_1", "k") in freq and ("strct_m_1", "i") in freq


def test_cli_runs_as_a_module(spark):
    import os
    import subprocess
    import sys

    fx = load_fixture(spark, SF_SMALL)
    base = scratch_path(spark, "cli")
    fx.polygons.write.option("header", True).option("nullValue", "NA").csv(f"{base}/polygons")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": root}
    res = subprocess.run(
        [sys.executable, "-m", "ecotally.jobs", "qa", "--polygons", f"{base}/polygons", "--polygons-format", "csv",
         "--out", f"{base}/out"],
        cwd=root, env=env, capture_output=True, text=True, timeout=300,
    )
    assert res.returncode == 0, res.stderr[-2000:]
    shares = files.read_typed_csv(spark, commit.report_paths(spark, f"{base}/out")["share_sums"], {"share_sum": "int", "n": "bigint"})
    assert sum(r["n"] for r in shares.collect()) == fx.polygons.count()
