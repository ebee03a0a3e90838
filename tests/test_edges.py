"""Hand-made edge rows (FIXTURES.md part 3): one per missing-value rule."""

import glob
import os


from ecotally.functions.nulls import expr
from ecotally.functions.area import to_unit
from ecotally.functions.keys import ecosystem_unit, split_key
from ecotally.operators.aggregate import crosstab, crosstabs
from ecotally.schema import RATING_KEY_PARTS_SITE
from ecotally.operators.lookup import crosswalk, lookup
from ecotally.operators.reshape import to_long, to_wide
from ecotally.plans import ecosystems as eco
from ecotally.plans import parcels, qa, ratings
from ecotally.session import scratch_path
from ecotally.sources import files
from helpers import categories, map_codes, polygons, sheet


def test_h1_missing_share_makes_group_total_missing(spark):
    p = polygons(spark, [
        {"sitemc_1": "AM", "strct_1": "3", "sdec_1": 5, "area": 10.0},
        {"sitemc_1": "AM", "strct_1": "3", "sdec_1": None, "area": 10.0},
    ])
    rows = eco.eu_units(eco.components(p)).collect()
    assert len(rows) == 1 and rows[0]["area_t"] is None and rows[0]["n"] == 2


def _eu_zone(spark, rows):
    """EU-by-zone rows; the last field is the area in m2 (stored as area_t,
    i.e. 1/100 m2 x tenths of share)."""
    rows = [(*r[:-1], r[-1] * 1000.0) for r in rows]
    return spark.createDataFrame(rows, "paz string, strct string, type string, structural_class string, area_t double")


def test_h2_missing_type_kept_on_transmission_line(spark):
    e = _eu_zone(spark, [("Transmission Line ROW", "4", None, "Young Forest", 10.0)])
    assert [tuple(r) for r in eco.eu_after(e).collect()] == [(None, "Shrub", 10.0)]


def test_h3_missing_stage_kept_as_text_na_and_3a_removed(spark):
    e = _eu_zone(spark, [
        ("Transmission Line ROW", None, "Upland Forest", "NA", 1.0),
        ("Transmission Line ROW", "3a", "Upland Forest", "NA", 1.0),
        ("Dam", "4", "Upland Forest", "Young Forest", 1.0),
        (None, "2", "Upland Forest", "Herbaceous", 1.0),
    ])
    assert [tuple(r) for r in eco.eu_after(e).collect()] == [("Upland Forest", "NA", 1.0)]


def test_after_class_excludes_water_and_anthropogenic(spark):
    e = _eu_zone(spark, [
        ("Transmission Line ROW", "2", "Water", "Herbaceous", 1.0),
        ("Transmission Line ROW", "2", "Anthropogenic Areas", "Herbaceous", 1.0),
        ("Transmission Line ROW", "6", "Wetland", "Mature Forest", 3.0),
    ])
    assert [tuple(r) for r in eco.eu_after(e).collect()] == [("Wetland", "Shrub", 3.0)]


def test_h4_present_missing_total_stays_missing_absent_cell_is_zero(spark):
    p = polygons(spark, [
        {"parcel_id": "A", "dist_type": "Footprint", "sitemc_1": "AM", "sdec_1": None, "area": 10000.0},
        {"parcel_id": "A", "dist_type": None, "sitemc_1": "AM", "sdec_1": 10, "area": 10000.0},
        {"parcel_id": "B", "dist_type": None, "sitemc_1": "AM", "sdec_1": 10, "area": 20000.0},
    ])
    out = {r["parcel_id"]: r for r in parcels.parcel_area(parcels.parcel_units(p), parcels.footprint_classes(parcels.parcel_units(p))).collect()}
    assert out["A"]["footprint"] is None and out["A"]["not_footprint"] == 1.0 and out["A"]["parcel_area"] is None
    assert out["B"]["footprint"] == 0.0 and out["B"]["not_footprint"] == 2.0 and out["B"]["parcel_area"] == 2.0


def test_h5_missing_key_matches_missing_key(spark):
    eu = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "unit string, area_t double")
    t = spark.createDataFrame([(None, "no unit"), ("x", "ex")], "unit string, site_series_name string")
    out = {r["area_t"]: r["site_series_name"] for r in lookup(eu, t, ["unit"], table_rows=2).collect()}
    assert out == {1.0: "no unit", 2.0: "ex"}


def test_h6_missing_ecosystem_prints_na_in_unit(spark):
    df = spark.createDataFrame([(None, "3"), (None, None), ("AM", None)], "ecosystem string, strct string")
    assert [r[0] for r in df.select(expr(ecosystem_unit())).collect()] == ["NA3", "NA", "AM"]


def test_h7_split_on_runs_of_non_alphanumerics(spark):
    df = spark.createDataFrame([("KIP_BWBS_mw__SW",), ("a__b_3.1",)], "eco string")
    got = [tuple(r) for r in df.select(*[expr(e) for e in split_key("eco", 5)]).collect()]
    assert got == [("KIP", "BWBS", "mw", "SW", None), ("a", "b", "3", "1", None)]


def test_h8_duplicate_category_key_multiplies_area_and_is_reported(spark):
    p = polygons(spark, [{"sitemc_1": "SW", "strct_1": "2", "sdec_1": 10, "area": 100000.0}])
    mc = map_codes(spark, [("BWBSmw1", "SW", "Spruce", "Upland Forest")])
    cats = categories(spark, [("SW2", "DSG"), ("SW2", "DSS")])
    out = eco.habitat_summary(p, mc, cats, map_rows=1, cat_rows=2).collect()
    assert [(r["bhc20"], r["total_area"]) for r in out] == [("DSS", 10.0), ("DSG", 10.0)]
    assert sum(r["total_area"] for r in out) == 20.0
    d = eco.components(p)
    named = eco.eu_summary(d, mc, map_rows=1)
    stages = qa.area_conservation([("components", d), ("with_categories", eco.with_categories(named, cats, 2))])
    totals = {r["stage"]: r["total_area"] for r in stages.collect()}
    assert totals == {"components": 10.0, "with_categories": 20.0}
    dup = qa.duplicate_lookup_keys(eco.eu_units(d), [("cat", eco.categories_table(cats), "ecosystem_unit")]).collect()
    assert [(r["key"], r["n"]) for r in dup] == [("SW2", 2)]


def test_h9_value_outside_levels_is_missing_and_sorted_last(spark):
    p = polygons(spark, [
        {"sitemc_1": "BT", "strct_1": "1", "sdec_1": 10, "area": 10000.0},
        {"sitemc_1": "BT", "strct_1": "4", "sdec_1": 10, "area": 10000.0},
        {"sitemc_1": "AM", "strct_1": "6", "sdec_1": 10, "area": 10000.0},
    ])
    mc = map_codes(spark, [])
    cats = categories(spark, [("BT1", "ZZZ"), ("BT4", "FBT"), ("AM6", "DMF")])
    out = [(r["bhc20"], r["total_area"]) for r in eco.habitat_summary(p, mc, cats, map_rows=0, cat_rows=3).collect()]
    assert out == [("DMF", 1.0), ("FBT", 1.0), (None, 1.0)]


def test_h10_csv_missing_cells(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_text('a,b,c,d,n\nNA,,"", y ,x7\n')
    rows = files.read_typed_csv(spark, str(path), {"n": "int"}).collect()
    assert tuple(rows[0]) == (None, None, None, "y", None)


def test_h11_ids_are_carried_onto_every_component(spark):
    p = polygons(spark, [{"dist_type": "Footprint", "sitemc_1": "A", "sitemc_2": "B", "sitemc_3": "C",
                          "sdec_1": 5, "sdec_2": 3, "sdec_3": 2, "area": 1.0}])
    rows = to_long(p, ["fid", "dist_type"], ["sdec", "sitemc"]).collect()
    assert [(r["decile"], r["sitemc"], r["dist_type"]) for r in rows] == [
        ("Decile1", "A", "Footprint"), ("Decile2", "B", "Footprint"), ("Decile3", "C", "Footprint")]


def test_h12_repeated_component_rating(spark):
    rated = spark.createDataFrame([(1, "1", "H"), (1, "1", "L"), (1, "2", "M")], "fid bigint, decile string, rating string")
    assert [tuple(r) for r in ratings.rating_wide(rated).collect()] == [(1, "L", "M", None)]
    dup = qa.duplicate_components(rated, "rated").collect()
    assert [(r["key"], r["n"]) for r in dup] == [("1|1", 2)]


def test_h13_parcel_area_sums_all_classes(spark):
    p = polygons(spark, [
        {"parcel_id": "P", "dist_type": c, "sitemc_1": "AM", "sdec_1": 10, "area": a * 10000.0}
        for c, a in (("Dam", 1.0), ("Road", 2.0), (None, 4.0))
    ])
    rows = parcels.parcel_area(parcels.parcel_components(p), parcels.footprint_classes(parcels.parcel_units(p))).collect()
    assert rows[0]["parcel_area"] == 7.0
    assert sorted(rows[0].asDict()) == ["dam", "not_footprint", "parcel_area", "parcel_id", "road"]


def test_h14_apportioning_and_empty_component(spark):
    p = polygons(spark, [{"sitemc_1": "A", "sitemc_2": "B", "sdec_1": 6, "sdec_2": 4, "sdec_3": None, "area": 100.0}])
    rows = eco.components(p).select("sitemc", expr(f"{to_unit('area_t', 'm2')} AS area")).collect()
    assert [tuple(r) for r in rows] == [("A", 60.0), ("B", 40.0)]


def test_h15_crosstab_drops_missing_and_shows_zero(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "y")], "r string, c string")
    got = {r["r"]: (r["x"], r["y"]) for r in crosstab(df, "r", "c").collect()}
    assert got == {"a": (1, 0), "b": (0, 1)}


def test_h16_missing_category_gets_its_own_column(spark):
    eu = spark.createDataFrame([("P", None, 10.0), ("P", "DMF", 20.0)], "parcel_id string, bhc20 string, area_t double")
    eu = eu.selectExpr("parcel_id", "area_t", "coalesce(bhc20, 'NA') AS bhc")
    row = to_wide(eu, ["parcel_id"], "bhc", ["DMF", "NA"], "area_t", fill=0.0).collect()[0]
    assert (row["dmf"], row["na"]) == (20.0, 10.0)


def test_h17_missing_key_parts_match_in_both_modes(spark):
    p = polygons(spark, [{"eco_sec": "KIP", "bgc_vrt": None, "sitemc_1": "SW", "strct_1": "1", "sdec_1": 10,
                          "area": 1.0}])
    r = sheet(spark, [("KIP", "BWBS", "mw", None, "SW", None, None, "1", None, None, "L")],
              ["ECO_SEC", "BGC_ZONE", "BGC_SUBZON", "BGC_VRT", "SITEMC_S", "SITE_MA", "SITE_MB", "STRCT_S",
               "STRCT_M", "SERAL", "BSEOW_LI"])
    comps = ratings.rating_components(p)
    for mode in ("composed", "nullsafe"):
        rows = ratings.rate(comps, r, mode=mode, rating_rows=1).collect()
        assert [(x["decile"], x["rating"]) for x in rows] == [("1", "L")]


def test_h18_csv_numbers_without_exponent(spark):
    path = scratch_path(spark, "h18")
    files.write_csv(spark.createDataFrame([(12345678.9,)], "area double"), path)
    lines = set()
    for f in glob.glob(os.path.join(path, "part-*")):
        lines.update(open(f).read().splitlines())
    assert lines == {"area", "12345678.9"}


def test_csv_numbers_lose_nothing(spark):
    import random

    rng = random.Random(4)
    values = [0.0, -0.0, 0.1234567891, 1e-7, -2.5e-9, 123456789012345680.0, -1.5e22, 5e-324, 1.7976931348623157e308, 10.0, 1e7, 12345678.125]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", f"{files.plain_number('v')} AS t")
    for v, t in df.collect():
        assert float(t) == v and "E" not in t.upper() and not t.endswith(".0"), (v, t)
    path = scratch_path(spark, "lossless")
    files.write_csv(spark.createDataFrame([(None, "0.12345678912345")], "v double, d string").selectExpr("v", "CAST(d AS DECIMAL(20,14)) AS d"), path)
    row = files.read_typed_csv(spark, path).collect()[0]
    assert (row["v"], row["d"]) == (None, "0.12345678912345")


def test_any_number_of_categories(spark):
    df = spark.range(20_000).selectExpr("concat('r', id % 3) AS r", "concat('c', id % 5000) AS c")
    long = crosstabs(df, [("r", "c")])
    assert long.count() == 15_000 and long.agg({"n": "sum"}).first()[0] == 20_000
    wide = crosstab(df.limit(1500), "r", "c")
    assert len(wide.columns) > 1001


def test_categories_that_are_none_are_refused(spark, monkeypatch):
    import pytest
    from ecotally.operators import aggregate

    df = spark.range(60).selectExpr("CAST(id % 2 AS STRING) AS r", "CAST(id AS STRING) AS c")
    with pytest.raises(ValueError, match="more than 50 values"):
        aggregate.distinct_values(df, "c", most=50)
    counts = crosstabs(df, [("r", "c")], zero_cells=False)
    with pytest.raises(Exception, match="2 x 60 cells, more than 100"):
        aggregate.with_zero_cells(counts, max_cells=100).collect()
    assert aggregate.with_zero_cells(counts, max_cells=120).count() == 120


def test_long_crosstab_shows_zero_cells(spark):
    rows = [("a", "x"), ("a", "x"), ("b", None), (None, "y"), (None, None)]
    out = crosstabs(spark.createDataFrame(rows, "r string, c string"), [("r", "c"), ("c", "c")]).collect()
    got = {(x["table"], x["row"], x["col"]): x["n"] for x in out}
    # a value seen only beside a missing one is a level: its cells show 0
    assert got == {("r_x_c", "a", "x"): 2, ("r_x_c", "a", "y"): 0, ("r_x_c", "b", "x"): 0, ("r_x_c", "b", "y"): 0,
                   ("c_x_c", "x", "x"): 2, ("c_x_c", "x", "y"): 0, ("c_x_c", "y", "x"): 0, ("c_x_c", "y", "y"): 1}


def test_totals_beyond_bigint_are_exact(spark):
    from ecotally.operators.aggregate import group_area

    big = 9_223_372_036_854_775_000
    df = spark.createDataFrame([("a", big), ("a", big), ("a", 7), ("a", -3), ("b", 5), ("b", None)], "k string, area_t bigint")
    out = {r["k"]: r["area_t"] for r in group_area(df, ["k"]).collect()}
    assert out == {"a": 2 * big + 4, "b": None}
    again = group_area(group_area(df.filter("area_t IS NOT NULL"), ["k"]).select("area_t"), []).first()
    assert again["area_t"] == 2 * big + 9
    wide = to_wide(df.withColumnRenamed("k", "z").selectExpr("1 AS i", "z", "area_t"), ["i"], "z", ["a", "b"], "area_t").first()
    assert (wide["a"], wide["b"]) == (2 * big + 4, None)


def test_fixed_point_areas_stay_exact(spark):
    from ecotally.functions.area import with_area_units

    for dtype, want in (("DECIMAL(15,2)", "bigint"), ("DECIMAL(17,2)", "bigint"), ("DECIMAL(18,2)", "decimal(38,6)"), ("DECIMAL(19,6)", "decimal(38,6)"), ("DOUBLE", "double")):
        df = with_area_units(spark.sql(f"SELECT CAST(12.25 AS {dtype}) AS area"))
        assert dict(df.dtypes)["area_u"] == want and float(df.first()["area_u"]) == 1225.0


def test_no_polygons_at_all(spark):
    p = polygons(spark, [{"sitemc_1": "AM", "area": 1.0}]).filter("false")
    mc, cats = map_codes(spark, [("BWBSmw1", "AM", "n", "t")]), categories(spark, [("AM6", "CMF")])
    assert parcels.parcel_report(p, mc, cats).count() == 0
    assert parcels.parcel_area(parcels.parcel_units(p), []).count() == 0
    unmapped = polygons(spark, [{"parcel_id": "P", "area": 1.0}])  # a polygon without a mapped component
    assert parcels.parcel_report(unmapped, mc, cats).count() == 0


def test_braces_in_a_category(spark):
    df = spark.createDataFrame([("P", "a{b}", 10.0), ("P", "{}", 5.0)], "k string, c string, area_t double")
    row = to_wide(df, ["k"], "c", ["a{b}", "{}"], "area_t", names=["x", "y"]).first()
    assert (row["x"], row["y"]) == (10.0, 5.0)


def test_empty_sheet_has_its_header(spark):
    path = scratch_path(spark, "empty-sheet")
    files.write_sheet(spark.createDataFrame([], "code string, area double"), path, ["Title"])
    back = files.read_sheet(spark, path, skip=1)
    assert back.columns == ["code", "area"] and back.count() == 0


def test_missing_duplicate_key_is_reported(spark):
    from ecotally.plans import qa

    rows = spark.createDataFrame([("u1",), (None,)], "unit string")
    table = spark.createDataFrame([(None, "x"), (None, "y"), ("u1", "z"), ("u2", "a"), ("u2", "b")], "unit string, name string")
    out = qa.duplicate_lookup_keys(rows, [("names", table, "unit")]).collect()
    assert [tuple(r) for r in out] == [("names", None, 2)]
    rated = spark.createDataFrame([(1, "1"), (1, "1"), (1, "2"), (None, "3"), (None, "3")], "fid bigint, decile string")
    got = sorted(tuple(r) for r in qa.duplicate_components(rated, "c").collect())
    assert got == [("c", "1|1", 2), ("c", "NA|3", 2)]


def test_terrestrial_spelling_can_be_rated(spark):
    from ecotally.operators.project import canonicalise
    from ecotally.schema import TEM

    raw = spark.createDataFrame([("e1", "KIP", "BWBS", "mw", "1", 10, "SW", "5", 2.5)],
                                "ECP_TAG string, Eco_Sec string, Bgc_Zone string, Bgc_Subzon string, Bgc_Vrt string, Sdec_1 int, SiteMC_S1 string, Strct_S1 string, Area_ha double")
    r = sheet(spark, [("KIP", "BWBS", "mw", "1", "SW", None, None, "5", None, None, "L")],
              ["ECO_SEC", "BGC_ZONE", "BGC_SUBZON", "BGC_VRT", "SITEMC_S", "SITE_MA", "SITE_MB", "STRCT_S", "STRCT_M", "SERAL", "BSEOW_LI"])
    out = ratings.rated_rows(ratings.rate(ratings.rating_components(canonicalise(raw, TEM)), r)).collect()
    assert [(x["fid"], x["decile"], x["area"], x["rating"]) for x in out] == [("e1", "1", 25000.0, "L")]


def test_crosswalk_unmatched_code_becomes_missing(spark):
    df = spark.createDataFrame([("AM:as", "AM"), ("XX", "XX")], "eco string, sitemc string")
    x = spark.createDataFrame([("AM:as", "AM2")], "eco string, sitemc_replace string")
    out = crosswalk(df, x, "eco", "eco", "sitemc_replace", "sitemc", table_rows=1).collect()
    assert sorted((r["eco"], r["sitemc"]) for r in out) == [("AM:as", "AM2"), ("XX", None)]


def test_not_in_keeps_missing_type(spark):
    from ecotally.functions.nulls import not_in_keep_missing
    df = spark.createDataFrame([("Water",), (None,), ("Wetland",)], "type string")
    got = [r[0] for r in df.filter(not_in_keep_missing("type", ["Water"])).collect()]
    assert got == [None, "Wetland"]


def test_stage_compare_is_text_never_cast(spark):
    from ecotally.functions.classify import structural_class
    df = spark.createDataFrame([("1",), ("3a",), ("7",), (None,), ("4",)], "strct string")
    got = [r[0] for r in df.select(expr(structural_class())).collect()]
    assert got == ["Non/sparsely vegetated", "NA", "Mature Forest", "NA", "Young Forest"]


def test_header_offset_sheet_round_trip(spark):
    path = scratch_path(spark, "sheet")
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "code string, area double")
    files.write_sheet(df, path, ["Title", "second title"], sort_by=["code"])
    back = files.read_sheet(spark, path, skip=2, types={"area": "double"})
    assert [tuple(r) for r in back.collect()] == [("a", 1.5), ("b", None)]


def test_workbook_stage_number_prints_whole(spark):
    from ecotally.operators.project import canonicalise
    from ecotally.schema import TEM
    raw = spark.createDataFrame([("e1", 3.0, 2.5, 4, "SW")], "ECP_TAG string, Strct_S1 double, Area_ha double, Sdec_1 int, SiteMC_S1 string")
    row = canonicalise(raw, TEM).collect()[0]
    assert row["strct_1"] == "3" and row["area"] == 25000.0 and row["sitemc_1"] == "SW" and row["cem_ecp"] == "e1"


def test_unique_lookup_refuses_repeated_keys(spark):
    import pytest

    eu = spark.createDataFrame([("SW2", 1.0)], "ecosystem_unit string, area_t double")
    cats = spark.createDataFrame([("SW2", "DSG"), ("SW2", "DSS"), ("AM5", "DYF")], "ecosystem_unit string, bhc20 string")
    assert lookup(eu, cats, ["ecosystem_unit"], table_rows=3).count() == 2
    with pytest.raises(ValueError, match="SW2"):
        lookup(eu, cats, ["ecosystem_unit"], table_rows=3, unique=True)


def test_split_exact_separator_mode(spark):
    df = spark.createDataFrame([("KIP_BWBS_mw__SW",)], "eco string")
    got = tuple(df.select(*[expr(e) for e in split_key("eco", 5, "_")]).collect()[0])
    assert got == ("KIP", "BWBS", "mw", "", "SW")


def test_eleven_part_key_when_site_series_present(spark):
    p = polygons(spark, [{"eco_sec": "KIP", "site_1": "102", "sitemc_1": "SW", "strct_1": "5", "strct_m_1": "i",
                          "sdec_1": 10, "area": 1.0}])
    parts = RATING_KEY_PARTS_SITE
    assert len(parts) == 11 and parts[4] == "SITE_S"
    r = sheet(spark, [("KIP", "BWBS", "mw", "1", "102", "SW", None, None, "5", None, None, "L"),
                      ("KIP", "BWBS", "mw", "1", "102", "SW", None, None, "5", "", None, "M")],
              ["ECO_SEC", "BGC_ZONE", "BGC_SUBZON", "BGC_VRT", "SITE_S", "SITEMC_S", "SITE_MA", "SITE_MB", "STRCT_S",
               "STRCT_M", "SERAL", "BSEOW_LI"])
    # without the clean-up the modifier 'i' matches nothing; with it, 'i' -> '' matches the second row
    raw = ratings.first_component_rating(p, r, parts, recodes=None, rating_rows=2).collect()[0]
    clean = ratings.first_component_rating(p, r, parts, rating_rows=2).collect()[0]
    assert raw["eco_1"] == "KIP_BWBS_mw_1_102_SW_NA_NA_5_i_NA" and raw["rating"] is None
    assert clean["eco_1"] == "KIP_BWBS_mw_1_102_SW_NA_NA_5__NA" and clean["rating"] == "M"
    rated = ratings.rate(ratings.rating_components(p, parts), r, parts, rating_rows=2).collect()
    assert [(x["eco"], x["rating"]) for x in rated] == [("KIP_BWBS_mw_1_102_SW_NA_NA_5_i_NA", None)]


def test_category_columns_stay_unique(spark):
    from ecotally.operators.reshape import column_names

    assert column_names(["A", "a", "x y", "x_y", ""]) == ["a", "a_2", "x_y", "x_y_2", "na"]
    df = spark.createDataFrame([("r", "A"), ("r", "a"), ("r", "a")], "r string, c string")
    row = crosstab(df, "r", "c").collect()[0].asDict()
    assert row == {"r": "r", "a": 1, "a_2": 2}


def test_parcel_report_class_named_like_a_category(spark):
    p = polygons(spark, [
        {"parcel_id": "P", "dist_type": "CMF", "sitemc_1": "AM", "strct_1": "6", "sdec_1": 10, "area": 10000.0},
        {"parcel_id": "P", "dist_type": None, "sitemc_1": "AM", "strct_1": "6", "sdec_1": 10, "area": 20000.0},
    ])
    mc = map_codes(spark, [])
    cats = categories(spark, [("AM6", "CMF")])
    row = parcels.parcel_report(p, mc, cats, map_rows=0, cat_rows=1).collect()[0].asDict()
    assert row["cmf"] == 2.0 and row["cmf_2"] == 1.0 and row["not_footprint"] == 2.0 and row["parcel_area"] == 3.0
