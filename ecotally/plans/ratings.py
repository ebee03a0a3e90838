"""Wildlife habitat rating jobs (D1, D1b, D2, D11).

The rating table is a lookup on a composed key: ten parts in the rating job
(D1, D2), eleven with the site series number in the first-component job (D11);
which one is the caller's choice, never read off the columns.  Per-component
results join the component rows (``to_long``, narrow) to the sheet: no shuffle
of the rows.  Area reports first sum the area per key and component
(``rating_units``, the only shuffle of the rows, partial sums before it) and
join the ratings to that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.area import apportion, to_unit, with_area_units
from ..functions.classify import recode
from ..functions.keys import compose_key, split_key
from ..functions.nulls import expr, ident, lit, strict_sum, type_of
from ..operators.lookup import lookup
from ..operators.repeats import once_per_key, suspects
from ..operators.reshape import NUMBER_TAGS, to_long
from ..schema import (
    RATING_KEY_PARTS, RATING_PART_SOURCE, SPATIAL_RECODES, wide,
)

RATING_VALUE = "BSEOW_LI"
POLYGON_PARTS = ("eco_sec", "bgc_zone", "bgc_subzon", "bgc_vrt")


def rating_components(polygons: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS, positive_only: bool = True):
    """Component rows (all three, empty ones included) with the composed key
    ``eco``, the key parts and ``area_t``; with ``positive_only`` only
    components with area > 0 (drops shares of 0 and missing shares)."""
    fields = ["sdec"] + [RATING_PART_SOURCE[p] for p in parts if RATING_PART_SOURCE[p] not in POLYGON_PARTS]
    long = to_long(with_area_units(polygons), ["fid", *POLYGON_PARTS, "area", "area_u"], fields, tags=NUMBER_TAGS,
                   drop_empty=None)
    long = long.selectExpr("*", f"{compose_key([RATING_PART_SOURCE[p] for p in parts])} AS eco",
                           f"{apportion()} AS area_t")
    if positive_only:
        long = long.filter("area_t > 0")
    return long


def rating_table(ratings: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS, value: str = RATING_VALUE) -> DataFrame:
    """Rating sheet as (eco, rating) on the composed key."""
    return ratings.selectExpr(f"{compose_key([ident(p) for p in parts])} AS eco", f"{ident(value)} AS rating")


def rate(
    comps: DataFrame,
    ratings: DataFrame,
    parts: Sequence[str] = RATING_KEY_PARTS,
    mode: str = "composed",
    value: str = RATING_VALUE,
    rating_rows: int | None = None,
) -> DataFrame:
    """Rating per component (left join).

    ``composed``: on the text key (a missing part reads ``NA``), as the
    source does.  ``nullsafe``: on the parts themselves, missing matching
    missing — planned as one hash join on all parts; it differs only when a
    part holds the text ``NA`` or the separator.
    """
    if mode == "composed":
        return lookup(comps, rating_table(ratings, parts, value), ["eco"], null_safe=False, table_rows=rating_rows)
    if mode != "nullsafe":
        raise ValueError(mode)
    r = ratings.selectExpr(*[f"{ident(p)} AS __rk{i}" for i, p in enumerate(parts)], f"{ident(value)} AS rating")
    pairs = [(RATING_PART_SOURCE[p], f"__rk{i}") for i, p in enumerate(parts)]
    return lookup(comps, r, pairs, null_safe=True, table_rows=rating_rows)


def rated_rows(rated: DataFrame) -> DataFrame:
    """Report projection: FID, decile, key, area (m2), rating."""
    return rated.selectExpr("fid", "decile", "eco", f"{to_unit('area_t', 'm2')} AS area", "rating")


def rating_units(comps: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS) -> DataFrame:
    """Area per key and component (``eco``, its parts, ``decile``, ``area_t``,
    rows ``n``): the table that every area report of the job derives from."""
    cols = [RATING_PART_SOURCE[p] for p in parts]
    area = strict_sum("area_t", type_of(comps, "area_t"))
    # grouped by the parts; the key is composed on the result
    g = comps.groupBy(*cols, "decile").agg(expr(f"{area} AS area_t"), expr("count(1) AS n"))
    return g.selectExpr(f"{compose_key(cols)} AS eco", "*")


def rating_area(rated: DataFrame, first_only: bool = False, unit: str = "m2") -> DataFrame:
    """Area per rating over all components, or over the first only.  ``rated``
    holds rated units (or rated component rows)."""
    r = rated.filter(f"decile = {lit(NUMBER_TAGS[0])}") if first_only else rated
    area = strict_sum("area_t", type_of(rated, "area_t"))
    return r.groupBy("rating").agg(expr(f"{to_unit(area, unit)} AS area_tot"))


def rating_wide(rated: DataFrame) -> DataFrame:
    """One row per polygon, one rating column per component.  A repeated
    (FID, component) takes the largest rating (see ``qa.duplicate_keys``)."""
    cells = ", ".join(f"max(CASE WHEN decile = {lit(t)} THEN rating END) AS decile_{t}" for t in NUMBER_TAGS)
    return rated.sparkSession.sql(f"SELECT fid, {cells} FROM {{src}} GROUP BY fid", src=rated)


def _part(p: str, n: int) -> str:
    """Column of a key part of component ``n`` on the wide table."""
    src = RATING_PART_SOURCE[p]
    return src if src in POLYGON_PARTS else wide(src, n)


def wide_rated_keys(polygons: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS) -> DataFrame:
    """Per polygon with a component of area > 0 the composed keys ``eco_1`` to
    ``eco_3`` of such components (missing: no such component); narrow."""
    shown = [f"{apportion('area_u', wide('sdec', n))} > 0" for n in (1, 2, 3)]
    keys = ", ".join(f"CASE WHEN {x} THEN {compose_key([_part(p, n) for p in parts])} END AS eco_{n}" for n, x in zip((1, 2, 3), shown))
    # the filter names the areas, not the long keys: the planner derives further conditions from it
    return polygons.sparkSession.sql(f"SELECT fid, {keys} FROM {{src}} WHERE {' OR '.join(shown)}", src=with_area_units(polygons))


def rating_by_polygon(polygons: DataFrame, ratings: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS, value: str = RATING_VALUE,
                      rating_rows: int | None = None) -> DataFrame:
    """One row per polygon, one rating column per component, as
    ``rating_wide`` gives it, without shuffling the polygons: three keyed
    lookups on the polygon's own row.  Only polygons whose id is shown to
    repeat are grouped (largest rating)."""
    best = rating_table(ratings, parts, value).groupBy("eco").agg(expr("max(rating) AS rating"))
    rows = wide_rated_keys(polygons, parts)
    for n, tag in zip((1, 2, 3), NUMBER_TAGS):
        one = best.selectExpr("eco AS __eco", f"rating AS decile_{tag}")
        rows = lookup(rows, one, [(f"eco_{n}", "__eco")], null_safe=False, table_rows=rating_rows)
    cols = [f"decile_{t}" for t in NUMBER_TAGS]
    return once_per_key(rows.select("fid", *cols), "fid", [f"max({c}) AS {c}" for c in cols], suspects(polygons, "fid"))


def repeating_polygons(polygons: DataFrame, ratings: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS) -> DataFrame | None:
    """The polygons whose components may be rated more than once: those whose
    id may repeat, and those with a key that the sheet repeats.  None if
    there can't be any."""
    clean, some = suspects(polygons, "fid").split(polygons)
    again = rating_table(ratings, parts).groupBy("eco").agg(expr("count(1) AS n")).filter("n > 1")
    if clean is None or again.isEmpty():
        return some
    keys = ", ".join(f"{compose_key([_part(p, n) for p in parts])} AS __eco_{n}" for n in (1, 2, 3))
    keyed = polygons.sparkSession.sql(f"SELECT *, {keys} FROM {{src}}", src=clean)
    for n in (1, 2, 3):
        keyed = lookup(keyed, again.selectExpr("eco AS __again", f"true AS __hit_{n}"), [(f"__eco_{n}", "__again")], null_safe=False)
    hits = keyed.filter("coalesce(__hit_1, __hit_2, __hit_3)").select(*polygons.columns)
    return hits if some is None else some.unionByName(hits)


def unmatched(rated: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS, unit: str = "m2") -> DataFrame:
    """Keys with no rating and their area, the key split for reading; from
    rated units (or rated component rows)."""
    miss = rated.filter("area_t <> 0 AND rating IS NULL")
    area = strict_sum("area_t", type_of(rated, "area_t"))
    g = miss.groupBy("eco").agg(expr(f"{to_unit(area, unit)} AS area"))
    pieces = split_key("eco", len(parts))
    return g.selectExpr("eco", "area", *[f"{p} AS {name.lower()}" for p, name in zip(pieces, parts)])


def ecosystem_keys(units: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS) -> DataFrame:
    """Distinct composed keys with their parts and ``area_t``."""
    cols = [RATING_PART_SOURCE[p] for p in parts]
    return units.groupBy("eco", *cols).agg(expr(f"{strict_sum('area_t', type_of(units, 'area_t'))} AS area_t"))


def ecosystem_list(units: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS, unit: str = "m2") -> DataFrame:
    """Distinct composed keys with their area; parts carried (not re-split)."""
    return key_report(ecosystem_keys(units, parts), parts, unit)


def key_report(keys: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS, unit: str = "m2") -> DataFrame:
    return keys.selectExpr("eco", *[f"{RATING_PART_SOURCE[p]} AS {p.lower()}" for p in parts], f"{to_unit('area_t', unit)} AS area")


def wide_keys(polygons: DataFrame, parts: Sequence[str] = RATING_KEY_PARTS) -> DataFrame:
    """The composed key of each component on the wide table (no reshaping)."""
    keys = [f"{compose_key([_part(p, n) for p in parts])} AS eco_{n}" for n in (1, 2, 3)]
    return polygons.selectExpr("cem_ecp", *keys)


def first_component_rating(
    polygons: DataFrame,
    ratings: DataFrame,
    parts: Sequence[str] = RATING_KEY_PARTS,
    recodes=SPATIAL_RECODES,
    value: str = RATING_VALUE,
    rating_rows: int | None = None,
) -> DataFrame:
    """D11: clean modifiers, compose the three keys on the wide table, rate
    component 1 (join on differently named keys)."""
    p = recode(polygons, recodes) if recodes else polygons
    keyed = wide_keys(p, parts)
    r = rating_table(ratings, parts, value)
    return lookup(keyed, r, [("eco_1", "eco")], null_safe=False, table_rows=rating_rows)
