"""Area apportioning and units (SQL text).

A component's area is ``share/10 * polygon area``.  The library carries the
undivided product ``area_t = area_u * share``, where ``area_u`` is the
polygon area in hundredths of a square metre:

* from a fixed-point source with at most two decimals and 15 whole digits
  (``decimal(p, s<=2)``) ``area_u`` is an exact BIGINT that leaves room for
  the share, so every sum of ``area_t`` is exact in any order and runs as
  plain long arithmetic (Spark sums of wide decimals go through BigDecimal
  and byte buffers per row); totals are split sums (``nulls.total``);
* from any other fixed-point source it is an exact DECIMAL(38, 6);
* from any other source it is a double; sums of doubles are taken in bins of
  fixed powers of two (``nulls.double_total``), so they don't depend on the
  order of the rows either.

The single division happens at the report edge (``to_unit``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..schema import UNITS

AREA_UNITS_PER_M2 = 100  # area_u is in 1/100 m2
SHARE_DENOMINATOR = 10  # shares are in tenths


def area_units(df: DataFrame, area: str = "area") -> str:
    """``area_u``: the polygon area in 1/100 m2 — exact BIGINT or DECIMAL for a
    fixed-point area, double otherwise."""
    dtype = dict(df.dtypes)[area]
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", dtype)
    if m and int(m.group(2)) <= 2 and int(m.group(1)) - int(m.group(2)) <= 15:
        return f"CAST({area} * {AREA_UNITS_PER_M2} AS BIGINT)"
    if m:
        return f"CAST({area} * {AREA_UNITS_PER_M2} AS DECIMAL(38, 6))"
    return f"CAST({area} AS DOUBLE) * {float(AREA_UNITS_PER_M2)!r}D"


def with_area_units(df: DataFrame, area: str = "area") -> DataFrame:
    """The polygon table with ``area_u`` (computed once per polygon, before
    the components are split off)."""
    return df.selectExpr("*", f"{area_units(df, area)} AS area_u")


def apportion(area_u: str = "area_u", sdec: str = "sdec") -> str:
    """``area_t``: polygon area (1/100 m2) times the component share in tenths."""
    return f"{area_u} * {sdec}"


def to_unit(area_t: str = "area_t", unit: str = "m2") -> str:
    """An ``area_t`` value (or sum) in ``unit`` as double: one division."""
    return f"CAST({area_t} AS DOUBLE) / {float(SHARE_DENOMINATOR * AREA_UNITS_PER_M2 * UNITS[unit])!r}D"
