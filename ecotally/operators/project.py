"""Projections: canonical names, column ranges, column moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.nulls import ident
from ..schema import UNITS, SourceSpelling

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _as_code(c: str, dtype) -> str:
    """A code column as text; a whole number read as a float prints without
    ``.0`` (a stage ``3`` from a workbook must read ``3``, not ``3.0``)."""
    if isinstance(dtype, _FRACTIONAL):
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST(floor({c}) AS BIGINT) AS STRING) ELSE CAST({c} AS STRING) END"
    if isinstance(dtype, _INTEGRAL):
        return f"CAST({c} AS STRING)"
    return c


def canonicalise(df: DataFrame, spelling: SourceSpelling, keep: list[str] | None = None) -> DataFrame:
    """Pick and rename source columns to canonical names (PRJ-1).

    Codes become text, shares integers, the area square metres.  Only the
    columns asked for (``keep``) are selected, so the scan reads only those.
    """
    mapping = spelling.mapping(df.columns)
    if keep is not None:
        mapping = {k: v for k, v in mapping.items() if k in keep}
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for canon, src in mapping.items():
        c = ident(src)
        if canon == "area":
            factor = UNITS[spelling.area_unit]
            e = f"{c} * {factor}" if factor != 1 else c
        elif canon.startswith("sdec_"):
            e = f"CAST({c} AS INT)"
        elif canon == "fid":
            e = c
        else:
            e = _as_code(c, types[src])
        out.append(f"{e} AS {canon}")
    return df.selectExpr(*out)


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the contiguous column range ``first:last`` (inclusive)."""
    names = [c.lower() for c in df.columns]
    i, j = names.index(first.lower()), names.index(last.lower())
    return df.columns[i : j + 1]


def move_first(df: DataFrame, *cols: str) -> DataFrame:
    rest = [c for c in df.columns if c not in cols]
    return df.select(*cols, *rest)
