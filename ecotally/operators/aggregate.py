"""Aggregations: strict area sums, one-pass frequency tables, crosstabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import expr, ident, lit, strict_sum, type_of
from .reshape import column_names


def group_area(df: DataFrame, keys: Sequence[str], value: str = "area_t", out: str = "area_t", count: str | None = "n") -> DataFrame:
    """Strict area sum per group (partial aggregate before the shuffle, so a
    hot group costs one row per map task on the wire)."""
    aggs = [expr(f"{strict_sum(value, type_of(df, value))} AS {out}")]
    if count:
        aggs.append(expr(f"count(1) AS {count}"))
    return df.groupBy(*keys).agg(*aggs)


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-way tables of many columns in one pass: unpivot to
    (column, value), drop missing, count.  Counts are partial-aggregated, so
    the shuffle carries one row per distinct (column, value) per task."""
    long = df.selectExpr(*[f"CAST({ident(c)} AS STRING) AS {ident(c)}" for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    return long.filter("value IS NOT NULL").groupBy("column", "value").agg(expr("count(1) AS n"))


#: Most values of a category that may become columns, and most cells of a table whose empty cells are shown.
MAX_COLUMNS = 5_000
MAX_CELLS = 10_000_000


def distinct_values(df: DataFrame, col: str, most: int = MAX_COLUMNS) -> list:
    """Sorted distinct non-missing values of a category column.  They become
    columns, so the caller has them on the driver; a column with more than
    ``most`` of them is no category and is refused."""
    values = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{col} has more than {most} values: too many for columns (crosstabs gives the long form)")
    return sorted(values)


def pair_cells(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(table, row, col) of each column pair, as SQL."""
    return [(lit(f"{a}_x_{b}"), f"CAST({ident(a)} AS STRING)", f"CAST({ident(b)} AS STRING)") for a, b in pairs]


def with_zero_cells(counts: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Counts (table, row, col, n) completed to the whole table of every row
    value by every column value, as printed two-way tables are; a pair never
    seen shows 0.  Rows missing one variable are no cells, but the value of
    the other is a level.  A table of more than ``max_cells`` is an error when
    it runs."""
    # the conditions name n, so they stay above the aggregate that all branches share
    rows = counts.filter("if(n > 0, `row`, NULL) IS NOT NULL").select("table", "row").distinct()
    cols = counts.filter("if(n > 0, col, NULL) IS NOT NULL").select("table", "col").distinct()
    sizes = rows.groupBy("table").agg(expr("count(1) AS n_rows")).join(cols.groupBy("table").agg(expr("count(1) AS n_cols")), "table")
    fits = sizes.filter(f"CASE WHEN n_rows * n_cols > {max_cells} THEN CAST(raise_error(concat(`table`, ' has ', n_rows, ' x ', n_cols,"
                        f" ' cells, more than {max_cells}')) AS BOOLEAN) ELSE true END").select("table")
    grid = rows.join(fits, "table", "left_semi").join(cols, "table")
    seen = counts.selectExpr(*[f"if(n > 0, `{c}`, NULL) AS `{c}`" for c in ("table", "row", "col")], "n")
    return grid.join(seen, ["table", "row", "col"], "left").selectExpr("table", "row", "col", "coalesce(n, 0L) AS n")


def crosstabs(df: DataFrame, pairs: Sequence[tuple[str, str]], zero_cells: bool = True) -> DataFrame:
    """Two-way count tables of many column pairs in one pass and in long form:
    (table, row, col, n).  Rows missing either variable are not counted; pairs
    of values never seen show 0, or with ``zero_cells`` off have no row."""
    cells = ", ".join(f"named_struct('table', {t}, 'row', {r}, 'col', {c})" for t, r, c in pair_cells(pairs))
    long = df.selectExpr(f"inline(array({cells}))")
    keep = "`row` IS NOT NULL OR col IS NOT NULL" if zero_cells else "`row` IS NOT NULL AND col IS NOT NULL"
    counts = long.filter(keep).groupBy("table", "row", "col").agg(expr("count(1) AS n"))
    return with_zero_cells(counts) if zero_cells else counts


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """Two-way count table: rows missing either variable are not counted;
    pairs never seen show 0 (``table(a, b)``).  One column per value of
    ``col``, so its ``values`` are asked for first when not given."""
    both = df.filter(f"{ident(row)} IS NOT NULL AND {ident(col)} IS NOT NULL")
    if values is None:
        values = distinct_values(both, col)
    if not values:  # no counted pair at all: an empty table
        return both.select(row).distinct()
    names = column_names(values, taken=[row])
    aggs = [expr(f"count(CASE WHEN {ident(col)} = {lit(v)} THEN 1 END) AS {ident(n)}") for v, n in zip(values, names)]
    return both.groupBy(row).agg(*aggs)
