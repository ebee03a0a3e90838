"""Wide <-> long reshaping without shuffles where the data allows it.

``to_long`` turns the three component column groups of a polygon into rows
with one ``inline`` over an array of structs: a narrow (per-row) operator, so
it pipelines into the scan and needs no exchange.  Empty components are
removed by a filter fused into the same code-generated stage.

``to_wide`` is conditional aggregation: one hash aggregate (partial before
the shuffle, final after) with three small aggregates per output column,
which also gives the exact fill rules: an *absent* cell takes ``fill``, a
present but missing total stays missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions.nulls import SUM_PART, expr, ident, lit, total, type_of
from ..schema import COMPONENTS, wide

DECILE_TAGS = ("Decile1", "Decile2", "Decile3")
NUMBER_TAGS = ("1", "2", "3")


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    fields: Sequence[str],
    tags: Sequence[str] = DECILE_TAGS,
    tag_col: str = "decile",
    drop_empty: str | None = "sitemc",
    components: Sequence[int] = COMPONENTS,
) -> DataFrame:
    """One row per component: ``ids`` + ``tag_col`` + one column per field.

    A field absent from ``df`` becomes a missing text column.  With
    ``drop_empty`` set, components whose field is missing are not emitted.
    """
    present = set(df.columns)

    def field(f: str, n: int) -> str:
        name = wide(f, n)
        return f"{lit(f)}, " + (ident(name) if name in present else "CAST(NULL AS STRING)")

    structs = [
        f"named_struct({lit(tag_col)}, {lit(tag)}, " + ", ".join(field(f, n) for f in fields) + ")"
        for tag, n in zip(tags, components)
    ]
    long = df.selectExpr(*[ident(i) for i in ids], "inline(array(" + ", ".join(structs) + "))")
    if drop_empty is not None:
        # a plain filter right above the Generate stays in the same codegen
        # stage (a lambda filter on the array would run interpreted)
        long = long.filter(f"{ident(drop_empty)} IS NOT NULL")
    return long


def column_name(value: str) -> str:
    """Report column name for a category value: lower case, runs of
    non-alphanumerics as ``_``."""
    return re.sub(r"[^a-z0-9]+", "_", str(value).lower()).strip("_") or "na"


def column_names(values: Sequence[str], taken: Sequence[str] = ()) -> list[str]:
    """``column_name`` of each value, made unique (``_2``, ``_3``, ...) where
    two values read the same (``A`` / ``a``) or a name is already ``taken``."""
    seen = {t.lower() for t in taken}
    out = []
    for v in values:
        base = name = column_name(v)
        k = 2
        while name in seen:
            name, k = f"{base}_{k}", k + 1
        seen.add(name)
        out.append(name)
    return out


def labelled(df: DataFrame, names: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """``df`` whose columns ``names`` carry the category values they stand for
    as metadata (``label``), for the header of an export."""
    for name, label in zip(names, labels):
        df = df.withMetadata(name, {"label": str(label)})
    return df


#: Type name of totals that were split into the columns HIGH and LOW.
SPLIT, HIGH, LOW = "split", "__high", "__low"


def split_totals(df: DataFrame, value: str) -> DataFrame:
    """``df`` with an exact total (DECIMAL(38,0)) in two BIGINT parts beside
    it, computed once per row: many cells then add longs, not decimals."""
    return df.selectExpr("*", f"CAST({ident(value)} div {SUM_PART} AS BIGINT) AS {HIGH}", f"CAST({ident(value)} % {SUM_PART} AS BIGINT) AS {LOW}")


def joined_totals(high: str, low: str) -> str:
    return f"(CAST({high} AS DECIMAL(31,0)) * {SUM_PART} + {low})"


def wide_cells(
    names_from: str,
    values: Sequence[str],
    value: str,
    names: Sequence[str] | None = None,
    fill=None,
    convert: Callable[[str], str] | None = None,
    where: str | None = None,
    dtype: str = "bigint",
) -> list[str]:
    """Aggregate expressions, one per category: strict sum of ``value`` over
    the rows of that category (and ``where``), converted, ``fill`` where
    there is no row."""
    names = list(names) if names is not None else column_names(values)
    cells = []
    for v, name in zip(values, names):
        hit = f"{ident(names_from)} = {lit(v)}" + (f" AND ({where})" if where else "")
        n_rows = f"count(CASE WHEN {hit} THEN 1 END)"
        if dtype == SPLIT:  # two BIGINT columns, see split_totals
            area = joined_totals(*[f"sum(CASE WHEN {hit} THEN {c} END)" for c in (HIGH, LOW)])
        else:
            area = total(f"CASE WHEN {hit} THEN {value} END", dtype)
        cell = f"CASE WHEN {n_rows} = count(CASE WHEN {hit} THEN {value} END) THEN {area} END"
        if convert is not None:
            cell = convert(cell)
        if fill is not None:
            cell = f"CASE WHEN {n_rows} = 0 THEN {lit(fill)} ELSE {cell} END"
        cells.append(f"{cell} AS {ident(name)}")
    return cells


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values: Sequence[str],
    value: str,
    fill=None,
    names: Sequence[str] | None = None,
    convert: Callable[[str], str] | None = None,
    where: str | None = None,
) -> DataFrame:
    """Long -> wide with an explicit category list (no plan-time job).

    ``convert`` maps each aggregated cell (SQL text, e.g. a unit
    conversion); ``fill`` is applied to absent cells after conversion.
    With ``where`` only rows meeting it count, and only groups with such
    rows are returned (a conditional aggregate instead of a filter, so the
    input plan stays identical to other consumers of ``df`` and Spark can
    reuse its exchange).
    """
    dtype = type_of(df, value)
    if dtype == "decimal(38,0)":
        df, dtype = split_totals(df, value), SPLIT
    cells = [expr(c) for c in wide_cells(names_from, values, value, names, fill, convert, where, dtype)]
    if where:
        cells.append(expr(f"count(CASE WHEN {where} THEN 1 END) AS __n_where"))
    if not cells:  # no category at all: the keys alone
        return df.select(*ids).distinct()
    wide_rows = df.groupBy(*ids).agg(*cells)
    return wide_rows.filter("__n_where > 0").drop("__n_where") if where else wide_rows


def row_total(cols: Sequence[str]) -> str:
    """Row-wise sum with ``+``: missing when any part is missing; 0 of none."""
    return " + ".join(ident(c) for c in cols) or "0.0D"
