"""Canonical column names, per-source spellings, units and fixed code lists.

Inside the library every table uses lower-case canonical names.  A polygon
table is *wide*: one row per map polygon with up to three components, the
component fields suffixed ``_1``, ``_2``, ``_3``.  Area is held in square
metres from load on; reports convert with an explicit unit.
"""

from __future__ import annotations

from dataclasses import dataclass

COMPONENTS = (1, 2, 3)

# Per-component fields (canonical long name -> meaning)
COMPONENT_FIELDS = (
    "sdec",     # share of the polygon in tenths (int)
    "site",     # site series number
    "sitemc",   # map code; missing = no such component
    "site_ma",  # site modifier A
    "site_mb",  # site modifier B
    "strct",    # structural stage (text; '1'..'7', may hold '3a')
    "strct_m",  # structural modifier
    "seral",    # seral association
)

def wide(field_name: str, n: int) -> str:
    """Canonical wide column name of a component field."""
    return f"{field_name}_{n}"


@dataclass(frozen=True)
class SourceSpelling:
    """How one source file spells the canonical columns."""

    name: str
    polygon: dict  # canonical -> source column
    component: dict  # canonical field -> pattern with {n}
    area_unit: str = "m2"  # unit of the source area column: 'm2' or 'ha'

    def mapping(self, available: list[str]) -> dict[str, str]:
        """canonical -> source column, restricted to columns present."""
        lower = {c.lower(): c for c in available}
        out = {}
        for canon, src in self.polygon.items():
            if src.lower() in lower:
                out[canon] = lower[src.lower()]
        for fld, pattern in self.component.items():
            for n in COMPONENTS:
                src = pattern.format(n=n)
                if src.lower() in lower:
                    out[wide(fld, n)] = lower[src.lower()]
        return out


# Column spellings of the two map sources (CEM/PEM attribute
# exports and the TEM workbook).
CEM = SourceSpelling(
    name="cem",
    polygon={
        "fid": "FID", "cem_ecp": "CEM_ECP", "parcel_id": "ParcelID_t", "paz": "PAZ",
        "dist_type": "Dist_Type", "location": "Location", "eco_sec": "ECO_SEC",
        "bgc_zone": "BGC_ZONE", "bgc_subzon": "BGC_SUBZON", "bgc_vrt": "BGC_VRT",
        "area": "AREA",
    },
    component={
        "sdec": "SDEC_{n}", "site": "SITE_S{n}", "sitemc": "SITEMC_S{n}",
        "site_ma": "SITE_M{n}A", "site_mb": "SITE_M{n}B", "strct": "STRCT_S{n}",
        "strct_m": "STRCT_M{n}", "seral": "SERAL_{n}",
    },
)
CEM_SHAPE_AREA = SourceSpelling(
    name="cem_shape_area", polygon={**CEM.polygon, "area": "Shape_Area"}, component=CEM.component,
)
TEM = SourceSpelling(
    name="tem",
    polygon={
        "fid": "ECP_TAG", "cem_ecp": "ECP_TAG", "eco_sec": "Eco_Sec", "bgc_zone": "Bgc_Zone",
        "bgc_subzon": "Bgc_Subzon", "bgc_vrt": "Bgc_Vrt", "area": "Area_ha",
        "location": "Location", "dist_type": "Dist_Type", "parcel_id": "ParcelID_t",
    },
    component={
        "sdec": "Sdec_{n}", "site": "Site_S{n}", "sitemc": "SiteMC_S{n}",
        "strct": "Strct_S{n}", "seral": "Seral_{n}",
    },
    area_unit="ha",
)
SOURCES = {s.name: s for s in (CEM, CEM_SHAPE_AREA, TEM)}

# Rating-table key columns, in key order (ten-part key; the
# spatial variant inserts SITE_S after BGC_VRT for an eleven-part key).
RATING_KEY_PARTS = (
    "ECO_SEC", "BGC_ZONE", "BGC_SUBZON", "BGC_VRT", "SITEMC_S",
    "SITE_MA", "SITE_MB", "STRCT_S", "STRCT_M", "SERAL",
)
RATING_KEY_PARTS_SITE = (
    "ECO_SEC", "BGC_ZONE", "BGC_SUBZON", "BGC_VRT", "SITE_S", "SITEMC_S",
    "SITE_MA", "SITE_MB", "STRCT_S", "STRCT_M", "SERAL",
)
# Headers of the exported reports.
DISPLAY_NAMES = {
    "sort": "Sort", "paz": "PAZ", "parcel_id": "ParcelID_t", "bec_variant": "BEC Variant", "ecosystem": "Ecosystem",
    "site_series": "Site Series", "site_series_name": "Site Series Name", "type": "Type", "strct": "STRCT",
    "ecosystem_unit": "Ecosystem Unit", "bhc20": "BHC20", "total_area": "Total_area", "fid": "FID",
    "decile_1": "Decile_1", "decile_2": "Decile_2", "decile_3": "Decile_3", "cem_ecp": "CEM_ECP",
    "area": "Area", "rating": "BSEOW_LI",
}
# canonical component-row column for each rating-key part
RATING_PART_SOURCE = {
    "ECO_SEC": "eco_sec", "BGC_ZONE": "bgc_zone", "BGC_SUBZON": "bgc_subzon",
    "BGC_VRT": "bgc_vrt", "SITE_S": "site", "SITEMC_S": "sitemc", "SITE_MA": "site_ma",
    "SITE_MB": "site_mb", "STRCT_S": "strct", "STRCT_M": "strct_m", "SERAL": "seral",
}

# Habitat-category (BHC20) levels in report order.
BHC_LEVELS = (
    "CMF", "CYF", "CSH",
    "DMF", "DYF", "DSH",
    "RMF", "RYF", "RSH",
    "FBS", "FBT",
    "WRI", "WSH", "WGR",
    "DSS", "DSG",
    "CUL", "NVE", "ANT",
    "WAT",
)

# Structural stage -> structural class.
STRUCTURAL_CLASSES = (
    (("1",), "Non/sparsely vegetated"),
    (("2",), "Herbaceous"),
    (("3",), "Shrub"),
    (("4", "5"), "Young Forest"),
    (("6", "7"), "Mature Forest"),
)
NA_TEXT = "NA"

# After-construction rule.
TL_ZONE = "Transmission Line ROW"
AFTER_TO_SHRUB = ("4", "5", "6", "7")
AFTER_KEEP = ("1", "2", "3")
AFTER_LOST = "Anthropogenic/Reservoir"
AFTER_EXCLUDED_TYPES = ("Anthropogenic Areas", "Water")

# Project activity zones and their report column names.
ZONE_COLUMNS = (
    ("Dam", "dam"),
    ("Reservoir", "reservoir"),
    ("Transmission Line ROW", "tl"),
    ("Hwy 29", "hwy_29"),
    ("Road", "road"),
    ("Quarry", "quarry"),
    ("Erosion Impact Area", "erosion_impact"),
)

# Printed headers of the zone columns.
ZONE_LABELS = {
    "dam": "Dam", "reservoir": "Reservoir", "tl": "TL", "hwy_29": "Hwy 29", "road": "Road", "quarry": "Quarry",
    "erosion_impact": "Erosion Impact",
}

NOT_FOOTPRINT = "Not footprint"
MARL_FEN = "Marl Fen Property"

# Structural-modifier clean-up rules of the spatial rating job
# (column, when-equal / when-id, new value).
SPATIAL_RECODES = (
    ("strct_m_1", "eq", "i", ""),
    ("strct_m_1", "eq", "s", ""),
    ("strct_m_3", "eq", "3", None),
    ("strct_3", "id", "87238", "3"),
)

# Area units: square metres per unit.
UNITS = {"m2": 1, "ha": 10000}
