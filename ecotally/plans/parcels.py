"""Parcel report (D9): footprint split per parcel and habitat categories of
the parcel area outside the footprint, one row per parcel.

Both halves come from one aggregate: area per (parcel, footprint class, BEC
variant, ecosystem, stage).  Strict sums compose, so the footprint split is
a roll-up of it and the habitat half is its rows outside the footprint; the
two branches share the same exchange, which Spark plans once (one scan, one
wide shuffle).  Both roll-ups are partial-aggregated per parcel, so a parcel
holding a third of all polygons costs one row per task on the wire; the two
per-parcel results are joined on the parcel id, and AQE picks broadcast or
shuffled join from their real sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.area import to_unit
from ..functions.nulls import ident, lit
from ..operators.aggregate import distinct_values
from ..operators.reshape import column_names, labelled, row_total, to_wide
from ..schema import BHC_LEVELS, NA_TEXT, NOT_FOOTPRINT
from .ecosystems import components, eu_units, with_categories, with_names

FOOTPRINT_CLASS = f"coalesce(dist_type, {lit(NOT_FOOTPRINT)})"
# Per-parcel results are grouped by a null-free form of the parcel id (text +
# "is missing" flag, one-to-one with the id, missing included): the report's
# join on them is then a plain equi-join whose required partitioning both
# grouped inputs already have (no extra exchange, even when not broadcast).
PARCEL_KEYS = ["__pkey", "__pnull"]
PARCEL_KEY_EXPRS = ["coalesce(CAST(parcel_id AS STRING), '') AS __pkey", "parcel_id IS NULL AS __pnull"]
PARCEL_ID = "CASE WHEN __pnull THEN NULL ELSE __pkey END AS parcel_id"


def parcel_components(polygons: DataFrame) -> DataFrame:
    return components(polygons, ids=["parcel_id", "dist_type"])


def parcel_units(polygons: DataFrame) -> DataFrame:
    """EU rows per parcel and footprint class (the one wide shuffle)."""
    return eu_units(parcel_components(polygons), by=["parcel_id", "dist_type"])


def footprint_classes(units: DataFrame) -> list[str]:
    """Footprint classes present among the units (any number of them; they
    become columns)."""
    return distinct_values(units.selectExpr(f"{FOOTPRINT_CLASS} AS dist_type"), "dist_type")


def parcel_area(units: DataFrame, classes: Sequence[str], unit: str = "ha", taken: Sequence[str] = (),
                keys: bool = False) -> DataFrame:
    """Area per parcel and footprint class (missing class = not footprint),
    absent cells 0, plus ``parcel_area`` over all classes.  ``units`` may be
    component rows or any finer aggregate with ``area_t``; class columns
    avoid the names in ``taken``.  With ``keys`` the parcel comes as the
    join keys ``PARCEL_KEYS`` instead of ``parcel_id``."""
    d = units.selectExpr(*PARCEL_KEY_EXPRS, "area_t", f"{FOOTPRINT_CLASS} AS dist_type")
    names = column_names(classes, taken=["parcel_id", "parcel_area", *taken])
    w = to_wide(d, PARCEL_KEYS, "dist_type", classes, "area_t", names=names, fill=0.0,
                convert=lambda c: to_unit(c, unit))
    out = w.selectExpr(*(PARCEL_KEYS if keys else [PARCEL_ID]), *[ident(n) for n in names], f"{row_total(names)} AS parcel_area")
    return labelled(out, names, classes)


def parcel_habitat(
    units: DataFrame, map_codes, categories, unit: str = "ha", levels: Sequence[str] = BHC_LEVELS,
    map_rows=None, cat_rows=None, keys: bool = False,
) -> DataFrame:
    """Habitat-category area per parcel outside the footprint: one column
    per level plus ``na`` (no or unknown category); absent cells 0; parcels
    with no area outside the footprint are not listed."""
    eu = with_categories(with_names(units, map_codes, map_rows), categories, cat_rows)
    eu = eu.selectExpr(*PARCEL_KEY_EXPRS, "area_t", "dist_type IS NULL AS outside",
                       f"coalesce(bhc20, {lit(NA_TEXT)}) AS bhc")
    values = [*levels, NA_TEXT]
    w = to_wide(eu, PARCEL_KEYS, "bhc", values, "area_t", fill=0.0, convert=lambda c: to_unit(c, unit),
                where="outside")
    w = labelled(w, column_names(values), values)
    return w if keys else w.selectExpr(PARCEL_ID, *[c for c in w.columns if c not in PARCEL_KEYS])


def parcel_report(polygons: DataFrame, map_codes, categories, classes=None, unit="ha", map_rows=None, cat_rows=None):
    """Habitat categories per parcel with the footprint split joined on.

    One scan and one wide shuffle shared by both halves (reused exchange).
    Without ``classes`` they are taken from the units first; pass units that
    are kept (``jobs.shared``) to ``parcel_report_from_units`` to avoid a
    second scan for that."""
    units = parcel_units(polygons)
    return parcel_report_from_units(units, map_codes, categories, classes or footprint_classes(units), unit, map_rows,
                                    cat_rows)


def parcel_report_from_units(units: DataFrame, map_codes, categories, classes, unit="ha", map_rows=None,
                             cat_rows=None) -> DataFrame:
    bhc = parcel_habitat(units, map_codes, categories, unit, map_rows=map_rows, cat_rows=cat_rows, keys=True)
    area = parcel_area(units, classes, unit, taken=bhc.columns, keys=True)
    out = bhc.join(area, PARCEL_KEYS, "left")  # missing parcel id matches missing, as in the source
    return out.selectExpr(PARCEL_ID, *[ident(c) for c in out.columns if c not in PARCEL_KEYS])
