"""Key building (SQL text): BEC variant, ecosystem label / unit, composed
rating keys and their split."""

from __future__ import annotations

from collections.abc import Sequence

from .nulls import lit, paste0, str_c, text_or_na

SPLIT_ANY_NON_ALNUM = "[^A-Za-z0-9]+"


def bec_variant(parts: int = 3, zone="bgc_zone", subzone="bgc_subzon", variant="bgc_vrt") -> str:
    """Zone + subzone [+ variant], missing if any piece is missing."""
    return str_c(*[zone, subzone, variant][:parts])


def ecosystem_label(sitemc="sitemc", seral="seral") -> str:
    """Map code, or ``code:seral`` when a seral association is present."""
    return f"CASE WHEN {seral} IS NULL THEN {sitemc} ELSE concat({sitemc}, ':', {seral}) END"


def ecosystem_unit(ecosystem="ecosystem", strct="strct") -> str:
    """Ecosystem + stage when a stage is present; missing pieces print ``NA``."""
    return f"CASE WHEN {strct} IS NOT NULL THEN {paste0(ecosystem, strct)} ELSE {paste0(ecosystem)} END"


def unit_key(bec="bec_variant", ecosystem="ecosystem") -> str:
    """Name-lookup key of an ecosystem-unit row (missing-propagating)."""
    return str_c(bec, ecosystem)


def lookup_unit_key(bec="bec_variant", map_code="map_code") -> str:
    """Name-lookup key on the map-code sheet (missing prints ``NA``)."""
    return paste0(bec, map_code)


def compose_key(cols: Sequence[str], sep: str = "_") -> str:
    """``unite``: pieces joined by ``sep``, a missing piece as ``NA``."""
    return f"concat_ws({lit(sep)}, " + ", ".join(text_or_na(c) for c in cols) + ")"


def split_key(key: str, n: int, pattern: str = SPLIT_ANY_NON_ALNUM) -> list[str]:
    """``separate``: split on a pattern; extra pieces dropped, short keys
    filled on the right with missing.  The default splits on any run of
    non-alphanumerics (an empty piece shifts later pieces left); ``"_"``
    splits on every separator exactly."""
    return [f"get(split({key}, {lit(pattern)}), {i})" for i in range(n)]
