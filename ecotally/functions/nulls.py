"""Spark SQL expressions with the missing-value rules of the analysed scripts.

Every helper returns Spark SQL *text* over column names (compose them freely,
apply with ``selectExpr`` / ``filter`` / ``expr``).  Building a job from SQL
text costs one parse per step instead of one JVM round trip per
sub-expression, and gives exactly the same Catalyst plan (codegen, no
Python at run time).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NA_TEXT


def expr(sql: str) -> Column:
    """A SQL expression as a Column."""
    return F.expr(sql)


def lit(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value) + ("D" if isinstance(value, float) else "")
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values: Iterable) -> str:
    return ", ".join(lit(v) for v in values)


def ident(name: str) -> str:
    """A column name as a SQL identifier."""
    return name if name.replace("_", "").isalnum() and not name[0].isdigit() else "`" + name.replace("`", "``") + "`"


#: Part size of a split BIGINT sum: both parts of a sum of 10^12 values stay far from the BIGINT limit.
SUM_PART = 1_000_000


#: Doubles are summed in bins of ``BIN_BITS`` bits: powers of two of the lowest bits of the five bins, and of the
#: first value above them.  A bin's sum has room for 2^39 rows.
BIN_BITS, BIN_FROM, BIN_TO = 24, -60, 60


def double_total(x: str) -> str:
    """Sum of a double that does not depend on the order of the rows.

    Each value below 2^60 is cut at fixed powers of two into five integers of
    24 bits (exact; what lies below 2^-60 is cut off), each bin is summed as
    BIGINT, and the five sums are joined once: they make two exact integers,
    of which the upper takes the carry of the lower.  Larger values, infinite
    ones and NaN are summed as doubles beside them."""
    near = f"CASE WHEN abs({x}) < {2.0 ** BIN_TO!r}D THEN {x} END"
    bins = []
    for low in range(BIN_FROM, BIN_TO, BIN_BITS):
        part = near if low + BIN_BITS == BIN_TO else f"({near}) % {2.0 ** (low + BIN_BITS)!r}D"
        bins.append(f"coalesce(sum(CAST(({part}) * {2.0 ** -low!r}D AS BIGINT)), 0L)")
    wide = [f"CAST({b} AS DECIMAL(20,0))" for b in bins]
    carry, half = 1 << 3 * BIN_BITS, 1 << 2 * BIN_BITS
    joined = f"named_struct('hi', {wide[4]} * {1 << BIN_BITS} + {wide[3]}, 'lo', {wide[2]} * {half} + {wide[1]} * {1 << BIN_BITS} + {wide[0]})"
    # lambdas name the integers once, so the text of the expression stays short
    rest = f"s -> named_struct('hi', s.hi, 'lo', s.lo, 'rest', pmod(s.lo, CAST({carry} AS DECIMAL(38,0))))"
    value = (f"r -> CAST(r.hi + (r.lo - r.rest) div {carry} AS DOUBLE) * {2.0 ** (BIN_FROM + 3 * BIN_BITS)!r}D"
             f" + (CAST(r.rest div {half} AS DOUBLE) * {2.0 ** (BIN_FROM + 2 * BIN_BITS)!r}D"
             f" + CAST(r.rest % {half} AS DOUBLE) * {2.0 ** BIN_FROM!r}D)")
    far = f"coalesce(sum(CASE WHEN NOT abs({x}) < {2.0 ** BIN_TO!r}D THEN {x} END), 0D)"
    return f"CASE WHEN count({x}) > 0 THEN get(transform(transform(array({joined}), {rest}), {value}), 0) + {far} END"


def total(x: str, dtype: str = "bigint") -> str:
    """Sum of ``x``, the same for any order of the rows.  A BIGINT is summed in
    two BIGINT parts (millions and the rest) that are joined as
    ``DECIMAL(38,0)`` after the sums, so totals beyond 9.2e18 stay exact at
    the speed of long arithmetic; doubles are summed in bins."""
    if dtype in ("double", "float"):
        return double_total(x if dtype == "double" else f"CAST({x} AS DOUBLE)")
    if dtype != "bigint":
        return f"sum({x})"
    return f"(CAST(sum({x} div {SUM_PART}) AS DECIMAL(31,0)) * {SUM_PART} + sum({x} % {SUM_PART}))"


def strict_sum(x: str, dtype: str = "bigint") -> str:
    """``total`` that is missing when any input is missing (R ``sum`` without
    ``na.rm``): one aggregate, partial before the shuffle."""
    return f"CASE WHEN count({x}) = count(1) THEN {total(x, dtype)} END"


def type_of(df, x: str) -> str:
    """SQL type of a column, which decides how it is summed."""
    return dict(df.dtypes)[x]


def text_or_na(x: str) -> str:
    """Missing shown as the text ``NA`` (``paste0`` / ``unite`` pieces)."""
    return f"coalesce(CAST({x} AS STRING), {lit(NA_TEXT)})"


def paste0(*parts: str) -> str:
    """``paste0``: concatenation where a missing piece prints as ``NA``."""
    return "concat(" + ", ".join(text_or_na(p) for p in parts) + ")"


def str_c(*parts: str) -> str:
    """``str_c``: concatenation where any missing piece makes it missing."""
    return "concat(" + ", ".join(parts) + ")"


def in_or_missing(x: str, values: Iterable) -> str:
    """``x %in% c(..., NA)``: missing matches."""
    return f"({x} IS NULL OR {x} IN ({lits(values)}))"


def not_in_keep_missing(x: str, values: Iterable) -> str:
    """``!x %in% c(...)``: true for a missing ``x`` (row kept)."""
    return f"NOT coalesce({x} IN ({lits(values)}), false)"


def na_text_to_null(x: str) -> str:
    """``na_if(x, "NA")``."""
    return f"nullif({x}, {lit(NA_TEXT)})"


def na_text_to_null_all(df, columns: Iterable[str] | None = None):
    """``na_if("NA")`` on every string column (or the given ones)."""
    string_cols = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    targets = string_cols if columns is None else set(columns) & string_cols
    return df.selectExpr(*[
        f"{na_text_to_null(ident(c))} AS {ident(c)}" if c in targets else ident(c) for c in df.columns
    ])
