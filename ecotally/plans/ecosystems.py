"""Ecosystem-unit jobs: EU summary (D3), map-code table by zone (D4),
after-construction table (D5), habitat-category summary (D6), property
split (D7), crosswalked summary (D8).

Shape of every job: scan -> ``to_long`` (narrow) -> one partial+final hash
aggregate on the unit keys -> broadcast lookups on the (small, bounded by
distinct codes) aggregate -> report.  Only the first aggregate shuffles data
that grows with the polygons; a hot unit is absorbed by the partial
aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.area import apportion, to_unit, with_area_units
from ..functions.classify import after_class, as_level, level_position, structural_class
from ..functions.keys import bec_variant, ecosystem_label, ecosystem_unit, lookup_unit_key, unit_key
from ..functions.nulls import expr, ident, lit, not_in_keep_missing, strict_sum, type_of
from ..operators.aggregate import group_area
from ..operators.lookup import crosswalk, lookup
from ..operators.reshape import to_long, to_wide
from ..schema import AFTER_EXCLUDED_TYPES, AFTER_LOST, MARL_FEN, ZONE_COLUMNS

EU_FIELDS = ("sdec", "sitemc", "strct", "seral")
EU_REPORT = ("bec_variant", "ecosystem", "site_series_name", "type", "strct", "structural_class")


def _snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def canonical_sheet(df: DataFrame) -> DataFrame:
    """Lookup sheet with snake_case names (``BEC Variant`` -> ``bec_variant``)."""
    return df.selectExpr(*[f"{ident(c)} AS {_snake(c)}" for c in df.columns])


def names_table(map_codes: DataFrame) -> DataFrame:
    """Map-code sheet keyed by ``unit`` = BEC variant + map code."""
    m = canonical_sheet(map_codes)
    unit = "unit" if "unit" in m.columns else f"{lookup_unit_key('bec_variant', 'map_code')} AS unit"
    text_sort = dict(m.dtypes).get("sort") == "string"  # a sheet read as text: order numerically
    rest = ["try_cast(sort AS INT) AS sort" if c == "sort" and text_sort else ident(c)
            for c in m.columns if c not in ("unit", "bec_variant", "map_code")]
    return m.selectExpr(unit, *rest)


def categories_table(categories: DataFrame) -> DataFrame:
    return canonical_sheet(categories).select("ecosystem_unit", "bhc20")


def components(
    polygons: DataFrame,
    ids: Sequence[str] = (),
    fields: Sequence[str] = EU_FIELDS,
    drop_empty: bool = True,
    bec_parts: int = 3,
) -> DataFrame:
    """Component rows with ``area_t``; only the columns the job needs."""
    base = ["bgc_zone", "bgc_subzon"] + (["bgc_vrt"] if bec_parts == 3 else [])
    long = to_long(with_area_units(polygons), [*ids, *base, "area", "area_u"], fields,
                   drop_empty="sitemc" if drop_empty else None)
    return long.selectExpr("*", f"{apportion()} AS area_t")


def eu_units(deciles: DataFrame, by: Sequence[str] = (), bec_parts: int = 3, ecosystem: str | None = None) -> DataFrame:
    """Area per (by, BEC variant, ecosystem, stage) — the one wide shuffle."""
    d = deciles.selectExpr(*by, "strct", "area_t", f"{bec_variant(bec_parts)} AS bec_variant",
                           f"{ecosystem or ecosystem_label()} AS ecosystem")
    eu = group_area(d, [*by, "bec_variant", "ecosystem", "strct"])
    return eu.selectExpr("*", f"{unit_key()} AS unit", f"{ecosystem_unit()} AS ecosystem_unit")


def eu_summary(
    deciles: DataFrame,
    map_codes: DataFrame,
    by: Sequence[str] = (),
    bec_parts: int = 3,
    ecosystem: str | None = None,
    map_rows: int | None = None,
) -> DataFrame:
    """EU rows with names and structural class; keeps ``area_t``."""
    return with_names(eu_units(deciles, by, bec_parts, ecosystem), map_codes, map_rows)


def with_names(eu: DataFrame, map_codes: DataFrame, map_rows: int | None = None) -> DataFrame:
    """Names by ``unit`` (null-safe) and the structural class of EU rows."""
    eu = lookup(eu, names_table(map_codes), ["unit"], table_rows=map_rows)
    return eu.selectExpr("*", f"{structural_class()} AS structural_class")


def _key_order(cols: Sequence[str]) -> list:
    """Group-key order of a summary: ascending, missing last."""
    return [expr(ident(c)).asc_nulls_last() for c in cols]


def eu_report(eu: DataFrame, by: Sequence[str] = (), unit: str = "m2", order: bool = True) -> DataFrame:
    """The EU table, rows in group-key order (zone, variant, ecosystem, stage)."""
    rep = eu.selectExpr(*by, *EU_REPORT, f"{to_unit('area_t', unit)} AS total_area")
    return rep.orderBy(*_key_order([*by, "bec_variant", "ecosystem", "strct"])) if order else rep


def with_categories(eu: DataFrame, categories: DataFrame, rows: int | None = None) -> DataFrame:
    """Habitat category by ``ecosystem_unit`` (no BEC variant in the key, so
    one unit may match several categories: rows and area multiply)."""
    out = lookup(eu, categories_table(categories), ["ecosystem_unit"], table_rows=rows)
    keep = [ident(c) for c in out.columns if c != "bhc20"]
    return out.selectExpr(*keep, f"{as_level('bhc20')} AS bhc20", f"{level_position('bhc20')} AS bhc_level")


def bhc_summary(eu_cat: DataFrame, by: Sequence[str] = (), unit: str = "ha", order: bool = True) -> DataFrame:
    """Area per habitat category, categories in level order, missing last."""
    area = strict_sum("area_t", type_of(eu_cat, "area_t"))
    g = eu_cat.groupBy(*by, "bhc20", "bhc_level").agg(expr(f"{to_unit(area, unit)} AS total_area"))
    if order:
        g = g.orderBy(*_key_order([*by, "bhc_level"]))
    return g.select(*by, "bhc20", "total_area")


def mc_report(eu_zone: DataFrame, map_codes: DataFrame, zones=ZONE_COLUMNS, unit: str = "m2", map_rows=None, order=True):
    """Map-code table: one column per project zone, ordered by ``sort``.

    Built from the EU-by-zone rows with one conditional aggregate (the zone
    roll-up and the pivot in a single exchange); an absent zone gives a
    missing column rather than an error.
    """
    values = [z for z, _ in zones]
    names = [n for _, n in zones]
    wide = to_wide(
        eu_zone.filter("ecosystem IS NOT NULL"), ["bec_variant", "ecosystem"], "paz", values, "area_t",
        names=names, convert=lambda c: to_unit(c, unit),
    ).selectExpr("*", f"{unit_key()} AS unit")
    rep = lookup(wide, names_table(map_codes), ["unit"], table_rows=map_rows)
    rep = rep.select("sort", "bec_variant", "ecosystem", "site_series", "site_series_name", "type", *names)
    if order:
        rep = rep.orderBy(expr("sort").asc_nulls_last(), "bec_variant", "ecosystem")
    return rep


def eu_after(eu_zone: DataFrame, unit: str = "m2", order: bool = True) -> DataFrame:
    """After-construction area by type and class (natural types only)."""
    e = eu_zone.selectExpr("type", "area_t", f"{after_class()} AS structural_class_after")
    e = e.filter(f"{not_in_keep_missing('type', AFTER_EXCLUDED_TYPES)} AND structural_class_after <> {lit(AFTER_LOST)}")
    area = strict_sum("area_t", type_of(e, "area_t"))
    g = e.groupBy("type", "structural_class_after").agg(expr(f"{to_unit(area, unit)} AS total_area"))
    return g.orderBy(*_key_order(["type", "structural_class_after"])) if order else g


def property_polygons(polygons: DataFrame, location: str = MARL_FEN, negate: bool = False) -> DataFrame:
    """Polygons of one property (or of all others) outside the footprint.
    A missing location is in neither part."""
    op = "<>" if negate else "="
    return polygons.filter(f"location {op} {lit(location)} AND dist_type IS NULL")


def habitat_summary(
    polygons: DataFrame, map_codes, categories, by: Sequence[str] = (), unit="ha", map_rows=None, cat_rows=None,
    order=True,
) -> DataFrame:
    """D6 end to end: polygons -> BHC area."""
    d = components(polygons, ids=by)
    eu = eu_summary(d, map_codes, by, map_rows=map_rows)
    return bhc_summary(with_categories(eu, categories, cat_rows), by, unit, order)


def crosswalked_components(polygons: DataFrame, xwalk: DataFrame, bec_parts: int = 2, xwalk_rows=None) -> DataFrame:
    """Component rows whose map code is replaced through the crosswalk,
    looked up on the ecosystem label; unmatched codes become missing."""
    d = components(polygons, bec_parts=bec_parts).selectExpr("*", f"{ecosystem_label()} AS eco")
    x = canonical_sheet(xwalk)
    return crosswalk(d, x, key="eco", table_key="eco", replacement="sitemc_replace", target="sitemc",
                     table_rows=xwalk_rows)


def crosswalked_habitat_summary(
    polygons, xwalk, map_codes, categories, unit="ha", xwalk_rows=None, map_rows=None, cat_rows=None, order=True,
):
    """D8: crosswalk, then EU summary on zone+subzone and the replaced code."""
    d = crosswalked_components(polygons, xwalk, xwalk_rows=xwalk_rows)
    eu = eu_summary(d, map_codes, bec_parts=2, ecosystem="sitemc", map_rows=map_rows)
    return bhc_summary(with_categories(eu, categories, cat_rows), unit=unit, order=order)
