"""Checkpoint figures of the fixture (FIXTURES.md part 2) at sf 0.01."""

import pytest

from ecotally.functions.nulls import expr
from ecotally.plans import ecosystems as eco
from ecotally.plans import parcels
from ecotally.queries import inputs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def i(spark):
    return inputs(spark, SF)


def counts(df, col):
    return {r[col]: r["n"] for r in df.groupBy(col).agg(expr("count(1) AS n")).collect()}


def test_polygons_and_components(i):
    assert i.polygons.count() == 15000
    assert i.deciles().count() == 33000


def test_eu_rows(i):
    assert eco.eu_units(i.deciles()).count() == 267
    assert i.eu_cat().count() == 271
    assert i.eu_cat(by=["paz"]).count() == 1203


def test_rating_counts(i):
    assert counts(i.rated(), "rating") == {"H": 28, "L": 126, "M": 52, "N": 593, None: 29129}
    # area not filtered, over the components that have a map code
    unfiltered = {"H": 28, "L": 126, "M": 53, "N": 1053, None: 31740}
    for mode in ("composed", "nullsafe"):
        assert counts(i.rated(positive_only=False, mode=mode).filter("sitemc IS NOT NULL"), "rating") == unfiltered
    # all three components of every polygon (empty ones included)
    assert i.rated(positive_only=False).count() == 45000


def test_crosswalk_counts(i):
    got = counts(eco.crosswalked_components(i.polygons, i.crosswalk, xwalk_rows=5), "sitemc")
    assert got == {"AM": 526, "BT": 2045, "FM": 878, "SW": 7184, "WS": 1967, None: 20400}


def test_other_property_outside_footprint(i):
    assert eco.property_polygons(i.polygons, negate=True).count() == 1985


def test_parcel_class_groups(i):
    g = parcels.parcel_components(i.polygons).selectExpr("parcel_id", "coalesce(dist_type, 'x') AS d").distinct()
    assert g.count() == 100


def test_share_sums(i):
    from ecotally.plans import qa
    assert {r["share_sum"]: r["n"] for r in qa.share_sums(i.polygons).collect()} == {10: 14928, 5: 28, 3: 29, 0: 15}


def test_property_parts_and_missing_location_make_the_whole(i):
    outside = i.polygons.filter("dist_type IS NULL")
    marl = eco.property_polygons(i.polygons)
    others = eco.property_polygons(i.polygons, negate=True)
    missing = outside.filter("location IS NULL")
    assert marl.count() + others.count() + missing.count() == outside.count()
    known = lambda p: eco.components(p).agg(expr("sum(area_t) AS a")).collect()[0]["a"]
    assert known(marl) + known(others) + known(missing) == known(outside)
