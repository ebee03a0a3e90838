"""Classifications (SQL text): structural class, after-construction class,
habitat levels, conditional cell recodes.  Stage codes are compared as
*text*: an ANSI numeric cast would fail on codes such as ``3a``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..schema import (
    AFTER_KEEP, AFTER_LOST, AFTER_TO_SHRUB, BHC_LEVELS, NA_TEXT, STRUCTURAL_CLASSES, TL_ZONE,
)
from .nulls import ident, in_or_missing, lit, lits


def structural_class(strct="strct") -> str:
    arms = " ".join(f"WHEN {strct} IN ({lits(stages)}) THEN {lit(label)}" for stages, label in STRUCTURAL_CLASSES)
    return f"CASE {arms} ELSE {lit(NA_TEXT)} END"


def after_class(paz="paz", strct="strct", current="structural_class") -> str:
    """Class after construction: forest stages on the transmission line
    become shrub; low stages (or a missing stage) there keep their class;
    everything else is lost to the project."""
    on_tl = f"{paz} = {lit(TL_ZONE)}"
    return (
        f"CASE WHEN {on_tl} AND {strct} IN ({lits(AFTER_TO_SHRUB)}) THEN 'Shrub'"
        f" WHEN {on_tl} AND {in_or_missing(strct, AFTER_KEEP)} THEN {current}"
        f" ELSE {lit(AFTER_LOST)} END"
    )


def level_position(x: str, levels: Sequence[str] = BHC_LEVELS) -> str:
    """1-based position of ``x`` in ``levels``; missing when not a level."""
    arms = " ".join(f"WHEN {lit(v)} THEN {i}" for i, v in enumerate(levels, start=1))
    return f"CASE {x} {arms} END"


def as_level(x: str, levels: Sequence[str] = BHC_LEVELS) -> str:
    """Factor with fixed levels: values outside the levels become missing."""
    return f"CASE WHEN {x} IN ({lits(levels)}) THEN {x} END"


def recode_exprs(columns: Sequence[str], rules: Sequence[tuple], id_col: str = "cem_ecp") -> dict[str, str]:
    """SQL per recoded column for conditional cell corrections applied in
    order.  A rule is ``(column, 'eq', match, value)`` (set the cell where it
    equals ``match``) or ``(column, 'id', record_id, value)`` (set the cell of
    one record).  A missing condition leaves the cell as it is."""
    out = {c: ident(c) for c in columns}
    for column, kind, match, value in rules:
        if column not in out:
            continue
        cond = f"{out[column]} = {lit(match)}" if kind == "eq" else f"{ident(id_col)} = {lit(match)}"
        out[column] = f"CASE WHEN coalesce({cond}, false) THEN CAST({lit(value)} AS STRING) ELSE {out[column]} END"
    return out


def recode(df: DataFrame, rules: Sequence[tuple], id_col: str = "cem_ecp") -> DataFrame:
    e = recode_exprs(df.columns, rules, id_col)
    return df.selectExpr(*[f"{e[c]} AS {ident(c)}" for c in df.columns])
