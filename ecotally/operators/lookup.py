"""Left lookups against reference sheets.

A lookup side is broadcast only when its size is *shown* to be small: by the
planner's own size of rows that are given with the plan (no job), or else by
measuring it, at most ``max_rows + 1`` rows, in rows and bytes.  The planned
size of a file proves nothing: millions of equal rows compress to kilobytes.  A row count
stated by the caller can only rule a broadcast out.  Above the bound the join
is a shuffled join whose hot keys are split: by AQE's skew-join handling when
the session has it on, else by salting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import expr, ident

# Largest lookup that is broadcast, in rows and in bytes of its values.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20
# Planned size below which given rows are taken as small without measuring them.
PLANNED_MAX_BYTES = 1 << 20
# Salt buckets for a shuffled lookup when AQE skew splitting is off.
SALT_BUCKETS = 16


def planned_bytes(table: DataFrame) -> int | None:
    """The planner's size of ``table`` where it bounds the rows from above:
    rows given with the plan, with filters and projections on top; None for
    anything else."""
    plan = table._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    given = all(leaves.apply(k).nodeName() in ("LocalRelation", "OneRowRelation") for k in range(leaves.size()))
    if not given or any(name in plan.toString() for name in ("Generate", "Expand", "Join", "Union", "Aggregate", "Range")):
        return None
    return int(plan.stats().sizeInBytes())


def measured(table: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[int, int]:
    """(rows, bytes) of ``table``, reading at most ``max_rows + 1`` rows."""
    size = " + ".join(f"coalesce(octet_length(CAST({ident(c)} AS STRING)), 0) + 8" for c in table.columns)
    n, b = table.limit(max_rows + 1).agg(expr("count(1)"), expr(f"coalesce(sum(CAST({size} AS BIGINT)), 0)")).first()
    return n, b


def fits_broadcast(table: DataFrame, table_rows: int | None = None, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``table`` is small enough to be sent to every executor.
    ``table_rows`` above the bound answers at once; below, it proves nothing."""
    if table_rows is not None and table_rows > max_rows:
        return False
    if max_rows >= BROADCAST_MAX_ROWS and max_bytes >= BROADCAST_MAX_BYTES:
        planned = planned_bytes(table)
        if planned is not None and planned <= PLANNED_MAX_BYTES:
            return True
    n, b = measured(table, max_rows)
    return n <= max_rows and b <= max_bytes


def _skew_split_on(spark) -> bool:
    conf = spark.conf
    return (conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"
            and conf.get("spark.sql.adaptive.skewJoin.enabled", "true").lower() == "true")


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str | tuple[str, str]],
    null_safe: bool = True,
    table_rows: int | None = None,
    how: str = "left",
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
    unique: bool = False,
    salt: int | None = None,
) -> DataFrame:
    """``left_join(df, table, by=on)``.

    ``on`` holds column names present on both sides, or ``(left, right)``
    pairs.  With ``null_safe`` a missing key matches a missing key.  Columns
    of ``table`` whose names are already in ``df`` are dropped (the report
    keeps the left-hand copy); duplicate keys in ``table`` multiply rows, as
    in the source scripts (see ``qa.duplicate_keys``); with ``unique`` the
    lookup refuses a table with repeated keys instead.

    A table above the broadcast bound is joined by shuffle.  A hot key (one
    key holding a large share of ``df``) then lands in one task unless it is
    split: AQE's skew-join splitting does that when enabled; otherwise (or
    with an explicit ``salt``) the join is salted: each ``df`` row gets a
    deterministic salt in ``[0, salt)`` from a hash of its columns, the table
    is replicated once per salt, and the salt joins the key.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    if unique:
        assert_unique_key(table, [r for _, r in pairs])
    right_keys = {r for _, r in pairs}
    left_cols = {c.lower() for c in df.columns}
    renamed = {r: f"__key_{i}" for i, (_, r) in enumerate(pairs)}
    keep = [c for c in table.columns if c not in right_keys and c.lower() not in left_cols]
    right = table.selectExpr(*[f"{ident(r)} AS {renamed[r]}" for r in renamed], *[ident(c) for c in keep])
    op = "<=>" if null_safe else "="
    cond = " AND ".join(f"{ident(l)} {op} {renamed[r]}" for l, r in pairs)
    if fits_broadcast(right, table_rows, max_rows, max_bytes):
        return df.join(F.broadcast(right), expr(cond), how).drop(*renamed.values())
    if salt is None:
        salt = 0 if _skew_split_on(df.sparkSession) else SALT_BUCKETS
    if salt > 1:
        row_hash = "xxhash64(" + ", ".join(ident(c) for c in df.columns) + ")"
        left = df.selectExpr("*", f"pmod({row_hash}, {salt}) AS __salt_l")
        right = right.selectExpr("*", f"explode(sequence(0, {salt - 1})) AS __salt_r")
        out = left.join(right, expr(f"{cond} AND __salt_l = __salt_r"), how)
        return out.drop(*renamed.values(), "__salt_l", "__salt_r")
    return df.join(right, expr(cond), how).drop(*renamed.values())


def assert_unique_key(table: DataFrame, keys: Sequence[str], show: int = 5) -> None:
    """Raise when a lookup table repeats a key (missing keys count as equal).
    One small aggregate over the lookup; at most ``show`` keys are fetched."""
    cols = [ident(k) for k in keys]
    dup = table.groupBy(*cols).agg(expr("count(1) AS n")).filter("n > 1").limit(show).collect()
    if dup:
        raise ValueError(f"lookup keys {list(keys)} repeat: " + ", ".join(str(tuple(r)) for r in dup))


def crosswalk(
    df: DataFrame,
    table: DataFrame,
    key: str,
    table_key: str,
    replacement: str,
    target: str,
    table_rows: int | None = None,
) -> DataFrame:
    """Replace ``target`` by the crosswalk's ``replacement`` looked up on
    ``key``.  An unmatched code becomes missing (no fall back to the old
    code), as in the source job."""
    t = table.selectExpr(f"{ident(table_key)} AS __xw_key", f"{ident(replacement)} AS __xw_new")
    joined = lookup(df, t, [(key, "__xw_key")], table_rows=table_rows)
    return joined.selectExpr(*[f"__xw_new AS {ident(c)}" if c == target else ident(c) for c in df.columns])
