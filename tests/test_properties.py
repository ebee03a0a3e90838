"""Property tests (hypothesis) on generated polygon tables."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ecotally.functions.area import to_unit
from ecotally.functions.nulls import expr
from ecotally.operators.reshape import to_long
from ecotally.plans import ecosystems as eco
from ecotally.plans import ratings
from helpers import categories, map_codes, polygons, sheet

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

codes = st.sampled_from(["AM", "SW", "SH", "BT"])
stages = st.sampled_from(["1", "2", "4", "6", None])
zones = st.sampled_from(["Dam", "Road", "Transmission Line ROW"])


@st.composite
def polygon_rows(draw, complete=True):
    n = draw(st.integers(1, 12))
    rows = []
    for _ in range(n):
        s1 = draw(st.integers(1, 10))
        s2 = draw(st.integers(0, 10 - s1))
        s3 = 10 - s1 - s2
        area = float(draw(st.integers(1, 10_000_000))) / 100
        rows.append({
            "paz": draw(zones), "area": area, "bgc_vrt": draw(st.sampled_from(["1", "2"])),
            "sitemc_1": draw(codes), "sdec_1": s1, "strct_1": draw(stages),
            "sitemc_2": draw(codes), "sdec_2": s2, "strct_2": draw(stages),
            "sitemc_3": draw(codes), "sdec_3": s3, "strct_3": draw(stages),
        })
    return rows


def _total(rows):
    return float(sum(Decimal(str(r["area"])) for r in rows))


@SETTINGS
@given(polygon_rows())
def test_component_areas_add_up_to_the_polygon_area(spark, rows):
    p = polygons(spark, rows)
    got = eco.components(p).agg(expr(f"{to_unit('sum(area_t)', 'm2')} AS a")).collect()[0]["a"]
    assert abs(got - _total(rows)) <= 1e-6 * max(1.0, _total(rows))


@SETTINGS
@given(polygon_rows())
def test_long_then_wide_gives_back_the_components(spark, rows):
    p = polygons(spark, rows)
    long = to_long(p, ["fid"], ["sitemc"], tags=("1", "2", "3"), drop_empty=None).withColumnRenamed("sitemc", "rating")
    wide = {r["fid"]: (r["decile_1"], r["decile_2"], r["decile_3"]) for r in ratings.rating_wide(long).collect()}
    assert wide == {i + 1: (r["sitemc_1"], r["sitemc_2"], r["sitemc_3"]) for i, r in enumerate(rows)}


@SETTINGS
@given(polygon_rows())
def test_rollups_are_additive_without_missing_values(spark, rows):
    p = polygons(spark, rows)
    mc = map_codes(spark, [("BWBSmw1", "AM", "Aspen", "Upland Forest"), ("BWBSmw2", "SW", "Spruce", "Upland Forest")])
    cats = categories(spark, [("AM1", "DMF"), ("SW2", "CYF"), ("SH4", "RSH")])
    by_zone = eco.habitat_summary(p, mc, cats, by=["paz"], map_rows=2, cat_rows=3, order=False)
    whole = eco.habitat_summary(p, mc, cats, map_rows=2, cat_rows=3, order=False)
    a = {}
    for r in by_zone.collect():
        a[r["bhc20"]] = a.get(r["bhc20"], 0.0) + r["total_area"]
    b = {r["bhc20"]: r["total_area"] for r in whole.collect()}
    assert a.keys() == b.keys()
    for k in b:
        assert abs(a[k] - b[k]) <= 1e-9 * max(1.0, abs(b[k]))
    assert abs(sum(b.values()) - _total(rows) / 10000) <= 1e-9 * max(1.0, _total(rows))


@SETTINGS
@given(polygon_rows(), st.lists(st.tuples(codes, stages, st.sampled_from(["H", "M", "L"])), max_size=6,
                                unique_by=lambda t: (t[0], t[1])))
def test_composed_key_join_equals_null_safe_join(spark, rows, table):
    p = polygons(spark, rows)
    r = sheet(spark, [("KIP", "BWBS", "mw", "1", c, None, None, s, None, None, v) for c, s, v in table],
              ["ECO_SEC", "BGC_ZONE", "BGC_SUBZON", "BGC_VRT", "SITEMC_S", "SITE_MA", "SITE_MB", "STRCT_S",
               "STRCT_M", "SERAL", "BSEOW_LI"])
    comps = ratings.rating_components(p)
    a = sorted(tuple(x) for x in ratings.rated_rows(ratings.rate(comps, r, mode="composed", rating_rows=6)).collect())
    b = sorted(tuple(x) for x in ratings.rated_rows(ratings.rate(comps, r, mode="nullsafe", rating_rows=6)).collect())
    assert a == b
