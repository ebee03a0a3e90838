"""Rows whose key repeats, found without shuffling the others.

Integer ids are counted into bitmaps, one for each bucket of 32,768
neighbouring ids (partial bitmaps are merged in the shuffle: about a bit per
id on the wire).  Where a bucket has more rows than set bits, it holds a
repeat; only the rows of such buckets are suspects and need a grouping step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import expr, ident
from .lookup import fits_broadcast

# Bitmaps pay while ids are not sparser than this: a bit for each possible id against eight bytes for each row.
MAX_SPREAD = 32
INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Suspects:
    """Which rows may have a key that repeats: those of ``buckets`` (None: all
    rows, as the key is no dense integer), and with ``nulls`` those without a
    key."""

    key: str
    buckets: DataFrame | None
    nulls: bool

    def none(self) -> bool:
        return self.buckets is not None and not self.nulls and self.buckets.isEmpty()

    def split(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows whose key is unique, rows that may repeat) of ``df``; None
        where there are none."""
        if self.buckets is None:
            return None, df
        if self.none():
            return df, None
        b = self.buckets.select(F.col("bucket").alias("__suspect"))
        b = F.broadcast(b) if fits_broadcast(b) else b
        on = expr(f"bitmap_bucket_number({ident(self.key)}) = __suspect")
        clean, some = df.join(b, on, "left_anti"), df.join(b, on, "left_semi")
        if self.nulls:
            return clean.filter(f"{ident(self.key)} IS NOT NULL"), some.unionByName(df.filter(f"{ident(self.key)} IS NULL"))
        return clean, some


def suspects(df: DataFrame, key: str) -> Suspects:
    """Two narrow passes over the key alone; the second only for dense integers."""
    k = ident(key)
    if dict(df.dtypes)[key] not in INTEGERS:
        return Suspects(key, None, False)
    n, rows, low, high = df.agg(expr(f"count({k})"), expr("count(1)"), expr(f"CAST(min({k}) AS BIGINT)"), expr(f"CAST(max({k}) AS BIGINT)")).first()
    if n and high - low + 1 > MAX_SPREAD * n:
        return Suspects(key, None, False)
    ids = df.filter(f"{k} IS NOT NULL").selectExpr(f"CAST({k} AS BIGINT) AS id")
    buckets = ids.groupBy(expr("bitmap_bucket_number(id) AS bucket")).agg(
        expr("count(1) AS n"), expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(id))) AS bits"))
    return Suspects(key, buckets.filter("n > bits").select("bucket"), rows - n > 1)


def once_per_key(df: DataFrame, key: str, merge: Sequence[str], found: Suspects | None = None) -> DataFrame:
    """``df`` with one row per key: rows that share a key are merged by the
    aggregates ``merge`` (SQL, one for each other column); rows whose key is
    unique pass as they are."""
    clean, some = (found or suspects(df, key)).split(df)
    if some is None:
        return clean
    merged = some.groupBy(key).agg(*[expr(m) for m in merge]).select(df.columns)
    return merged if clean is None else clean.unionByName(merged)
