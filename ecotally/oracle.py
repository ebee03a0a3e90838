"""DuckDB SQL for every registered query (the correctness oracle).

Each statement starts from the fixture CTEs (``sources.fixture``) over the
driver's pre-registered parquet views and restates the query in plain SQL:
``CASE WHEN COUNT(x)=COUNT(*) THEN SUM(x) END`` for the strict sum,
``IS NOT DISTINCT FROM`` for null-safe keys, ``||`` for missing-propagating
concatenation, ``COALESCE(x,'NA')`` for ``NA`` pieces.
"""

from __future__ import annotations

from .sources.fixture import TEM_SQL, duckdb_ctes

# Fixed values, stated here apart from the library's own lists: habitat
# categories in report order, and the zones with their report columns.
BHC_LEVELS = (
    "CMF", "CYF", "CSH", "DMF", "DYF", "DSH", "RMF", "RYF", "RSH", "FBS", "FBT", "WRI", "WSH", "WGR", "DSS", "DSG",
    "CUL", "NVE", "ANT", "WAT",
)
ZONE_COLUMNS = (
    ("Dam", "dam"), ("Reservoir", "reservoir"), ("Transmission Line ROW", "tl"), ("Hwy 29", "hwy_29"),
    ("Road", "road"), ("Quarry", "quarry"), ("Erosion Impact Area", "erosion_impact"),
)


def _tags(kind: str) -> tuple[str, str, str]:
    return ("Decile1", "Decile2", "Decile3") if kind == "decile" else ("1", "2", "3")


def comp_cte(name: str = "comp", kind: str = "decile") -> str:
    """All three components of every polygon, canonical names, area_t."""
    sel = []
    for n, tag in zip((1, 2, 3), _tags(kind)):
        sel.append(
            f"SELECT FID AS fid, CEM_ECP AS cem_ecp, ParcelID_t AS parcel_id, PAZ AS paz, Dist_Type AS dist_type,"
            f" Location AS location, ECO_SEC AS eco_sec, BGC_ZONE AS bgc_zone, BGC_SUBZON AS bgc_subzon,"
            f" BGC_VRT AS bgc_vrt, AREA AS area, '{tag}' AS decile, SDEC_{n} AS sdec, SITEMC_S{n} AS sitemc,"
            f" SITE_M{n}A AS site_ma, SITE_M{n}B AS site_mb, STRCT_S{n} AS strct, STRCT_M{n} AS strct_m,"
            f" SERAL_{n} AS seral, CAST(AREA * 100 AS BIGINT) * SDEC_{n} AS area_t FROM polygons"
        )
    return f"{name} AS (\n" + "\n UNION ALL ".join(sel) + ")"


DECILES = "deciles AS (SELECT * FROM comp WHERE sitemc IS NOT NULL)"
LABEL = "CASE WHEN seral IS NULL THEN sitemc ELSE sitemc || ':' || seral END"
STRICT_T = "CASE WHEN COUNT(area_t) = COUNT(*) THEN SUM(area_t) END"
SCLASS = (
    "CASE WHEN strct = '1' THEN 'Non/sparsely vegetated' WHEN strct = '2' THEN 'Herbaceous'"
    " WHEN strct = '3' THEN 'Shrub' WHEN strct IN ('4','5') THEN 'Young Forest'"
    " WHEN strct IN ('6','7') THEN 'Mature Forest' ELSE 'NA' END"
)
EUNIT = "CASE WHEN strct IS NOT NULL THEN COALESCE(ecosystem,'NA') || strct ELSE COALESCE(ecosystem,'NA') END"
LEVELS_IN = "(" + ",".join(f"'{v}'" for v in BHC_LEVELS) + ")"
LEVELS_LIST = "[" + ",".join(f"'{v}'" for v in BHC_LEVELS) + "]"
MC_NAMES = (
    "mc_names AS (SELECT COALESCE(bec_variant,'NA') || COALESCE(map_code,'NA') AS unit, Sort AS sort,"
    " site_series, site_series_name, Type AS type FROM map_codes)"
)
CATS = "cats AS (SELECT ecosystem_unit AS cat_unit, BHC20 AS bhc_raw FROM habitat_categories)"


def to_unit(expr: str, unit: str) -> str:
    """area_t is in 1/100 m2 x tenths of share: one division to the unit."""
    return f"CAST({expr} AS DOUBLE) / {1000 if unit == 'm2' else 10000000}"


def eu_ctes(by: str = "", src: str = "deciles", bec: str = "bgc_zone || bgc_subzon || bgc_vrt",
            eco: str = LABEL, prefix: str = "") -> list[str]:
    """EU rows (``{prefix}eu``), with names and class (``{prefix}eun``), with
    categories (``{prefix}euc``)."""
    b = f"{by}, " if by else ""
    return [
        f"{prefix}eu0 AS (SELECT {b}bec_variant, ecosystem, strct, {STRICT_T} AS area_t, COUNT(*) AS n"
        f" FROM (SELECT *, {bec} AS bec_variant, {eco} AS ecosystem FROM {src})"
        f" GROUP BY {b}bec_variant, ecosystem, strct)",
        f"{prefix}eu AS (SELECT *, bec_variant || ecosystem AS unit, {EUNIT} AS ecosystem_unit FROM {prefix}eu0)",
        f"{prefix}eun AS (SELECT e.*, m.sort, m.site_series, m.site_series_name, m.type, {SCLASS} AS structural_class"
        f" FROM {prefix}eu e LEFT JOIN mc_names m ON e.unit IS NOT DISTINCT FROM m.unit)",
        f"{prefix}euc AS (SELECT e.*, CASE WHEN c.bhc_raw IN {LEVELS_IN} THEN c.bhc_raw END AS bhc20,"
        f" CASE WHEN c.bhc_raw IN {LEVELS_IN} THEN CAST(list_position({LEVELS_LIST}, c.bhc_raw) AS INTEGER) END"
        f" AS bhc_level, c.bhc_raw FROM {prefix}eun e LEFT JOIN cats c ON e.ecosystem_unit IS NOT DISTINCT FROM c.cat_unit)",
    ]


def sql(body: str, *ctes: str) -> str:
    head = duckdb_ctes().rstrip()
    extra = ",\n".join(ctes)
    return f"{head},\n{extra}\n{body}" if extra else f"{head}\n{body}"


EU_BASE = [comp_cte(), DECILES, MC_NAMES, CATS]
EU_ALL = EU_BASE + eu_ctes()
EU_ZONE = EU_BASE + eu_ctes(by="paz")
EU_REPORT_COLS = "bec_variant, ecosystem, site_series_name, type, strct, structural_class"

RATING_PARTS_SQL = "eco_sec, bgc_zone, bgc_subzon, bgc_vrt, sitemc, site_ma, site_mb, strct, strct_m, seral"
RATING_PART_NAMES = ("eco_sec", "bgc_zone", "bgc_subzon", "bgc_vrt", "sitemc_s", "site_ma", "site_mb",
                     "strct_s", "strct_m", "seral")


def ukey(cols: str) -> str:
    return "CONCAT_WS('_', " + ", ".join(f"COALESCE({c.strip()},'NA')" for c in cols.split(",")) + ")"


RKEY = ukey("ECO_SEC,BGC_ZONE,BGC_SUBZON,BGC_VRT,SITEMC_S,SITE_MA,SITE_MB,STRCT_S,STRCT_M,SERAL")
RATED_BASE = [
    comp_cte("rcomp", "number"),
    f"keyed AS (SELECT *, {ukey(RATING_PARTS_SQL)} AS eco FROM rcomp)",
    f"rtab AS (SELECT {RKEY} AS reco, BSEOW_LI AS rating FROM ratings)",
    "rated AS (SELECT k.*, r.rating FROM keyed k LEFT JOIN rtab r ON k.eco = r.reco WHERE k.area_t > 0)",
]


# every 97th polygon has the id of the one before, the water keys of the sheet stand twice
REPEATED_BASE = [
    RATED_BASE[0],
    f"keyed AS (SELECT * REPLACE (CASE WHEN fid % 97 = 0 THEN fid - 1 ELSE fid END AS fid), {ukey(RATING_PARTS_SQL)} AS eco FROM rcomp)",
    f"rtab AS (SELECT {RKEY} AS reco, BSEOW_LI AS rating FROM ratings UNION ALL SELECT {RKEY}, 'W' FROM ratings WHERE SITEMC_S = 'OW')",
    RATED_BASE[3],
]


def split_cols(expr: str, names=RATING_PART_NAMES, na_to_null: bool = False) -> str:
    out = []
    for i, n in enumerate(names, start=1):
        piece = f"regexp_split_to_array({expr}, '[^A-Za-z0-9]+')[{i}]"
        if na_to_null:
            piece = f"NULLIF({piece}, 'NA')"
        out.append(f"{piece} AS {n}")
    return ", ".join(out)


RKEY_SITE = ukey("ECO_SEC,BGC_ZONE,BGC_SUBZON,BGC_VRT,SITE_S,SITEMC_S,SITE_MA,SITE_MB,STRCT_S,STRCT_M,SERAL")


def wide_key(n: int, site: bool = False) -> str:
    series = f"SITE_S{n}," if site else ""
    return ukey(f"ECO_SEC,BGC_ZONE,BGC_SUBZON,BGC_VRT,{series}SITEMC_S{n},SITE_M{n}A,SITE_M{n}B,STRCT_S{n},STRCT_M{n},SERAL_{n}")


ZONE_CELLS = ", ".join(
    f"CASE WHEN COUNT(*) FILTER (WHERE paz = '{z}') = COUNT(area_t) FILTER (WHERE paz = '{z}')"
    f" THEN {to_unit(f'SUM(area_t) FILTER (WHERE paz = {chr(39)}{z}{chr(39)})', 'm2')} END AS {c}"
    for z, c in ZONE_COLUMNS
)
ZONE_NAMES = ", ".join(c for _, c in ZONE_COLUMNS)


def fill_cells(cat: str, values, names) -> str:
    """Conditional strict sums in ha, absent cells 0."""
    cells = []
    for v, name in zip(values, names):
        f = f"FILTER (WHERE {cat} = '{v}')"
        cells.append(
            f"CASE WHEN COUNT(*) {f} = 0 THEN 0.0 WHEN COUNT(*) {f} = COUNT(area_t) {f}"
            f" THEN {to_unit(f'SUM(area_t) {f}', 'ha')} END AS {name}"
        )
    return ", ".join(cells)


BHC_VALUES = [*BHC_LEVELS, "NA"]
BHC_NAMES = [v.lower() for v in BHC_VALUES]
PARCEL_AREA = (
    "parea AS (SELECT parcel_id AS pid, "
    + fill_cells("dt", ["Footprint", "Not footprint"], ["footprint", "not_footprint"])
    + " FROM (SELECT *, COALESCE(dist_type, 'Not footprint') AS dt FROM deciles) GROUP BY parcel_id)"
)
PARCEL_BHC = (
    "pbhc AS (SELECT parcel_id, " + fill_cells("bhc", BHC_VALUES, BHC_NAMES)
    + " FROM (SELECT *, COALESCE(bhc20, 'NA') AS bhc FROM peuc) GROUP BY parcel_id)"
)
PARCEL_CTES = EU_BASE + eu_ctes(by="parcel_id", src="(SELECT * FROM deciles WHERE dist_type IS NULL)", prefix="p") + [
    PARCEL_AREA, PARCEL_BHC,
]

BHC_ROLLUP = f"SELECT bhc20, {to_unit(STRICT_T, 'ha')} AS total_area FROM euc GROUP BY bhc20"
XWALK = [
    comp_cte(), DECILES, MC_NAMES, CATS,
    f"xd AS (SELECT d.* EXCLUDE (sitemc), x.SITEMC_replace AS sitemc FROM (SELECT *, {LABEL} AS eco FROM deciles) d"
    " LEFT JOIN crosswalk x ON d.eco = x.eco)",
]

CANON_POLY = (
    "FID AS fid, CEM_ECP AS cem_ecp, ParcelID_t AS parcel_id, PAZ AS paz, Dist_Type AS dist_type,"
    " Location AS location, ECO_SEC AS eco_sec, BGC_ZONE AS bgc_zone, BGC_SUBZON AS bgc_subzon,"
    " BGC_VRT AS bgc_vrt, AREA AS area, "
    + ", ".join(
        f"SDEC_{n} AS sdec_{n}, SITE_S{n} AS site_{n}, SITEMC_S{n} AS sitemc_{n}, SITE_M{n}A AS site_ma_{n}, SITE_M{n}B AS site_mb_{n},"
        f" STRCT_S{n} AS strct_{n}, STRCT_M{n} AS strct_m_{n}, SERAL_{n} AS seral_{n}"
        for n in (1, 2, 3)
    )
)

QA_COLS = [f"{f}_{n}" for n in (1, 2, 3) for f in ("sdec", "sitemc", "seral", "strct")]
QA_PAIR_COLS = [(f"{x}_{n}", f"{y}_{n}") for x, y in (("sitemc", "seral"), ("strct", "strct_m")) for n in (1, 2, 3)]
QA_FREQ = " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM cpoly WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in QA_COLS
)

STAGES = [
    ("components", "deciles", "area_t"),
    ("eu_rows", "eu", "area_t"),
    ("eu_with_names", "eun", "area_t"),
    ("eu_with_categories", "euc", "area_t"),
]
CONSERVATION = " UNION ALL ".join(
    f"SELECT '{s}' AS stage, {to_unit(STRICT_T, 'ha')} AS total_area, {to_unit('SUM(area_t)', 'ha')} AS total_area_known,"
    f" COUNT(*) FILTER (WHERE area_t IS NULL) AS n_missing FROM {t}"
    for s, t, _ in STAGES
)

ODD_DOUBLE = "CAST(area AS DOUBLE) * 0.7310585786300049"


def exact_total(x: str) -> str:
    """Exact sum of non-negative doubles: integers of 2^-60 in a HUGEINT, read
    back in three parts that doubles hold exactly."""
    t = f"SUM(CAST({x} * 1152921504606846976.0::DOUBLE AS HUGEINT))"
    low = f"({t} % 4722366482869645213696)"
    return (f"(CAST({t} // 4722366482869645213696 AS DOUBLE) * 4096 + (CAST({low} // 281474976710656 AS DOUBLE) / 4096"
            f" + CAST({low} % 281474976710656 AS DOUBLE) / 1152921504606846976.0::DOUBLE))")


ORACLE: dict[str, str] = {
    "deciles_long": sql("SELECT fid, decile, sdec, sitemc, strct, seral FROM deciles", comp_cte(), DECILES),
    "apportion_area": sql(f"SELECT fid, decile, {to_unit('area_t', 'm2')} AS area FROM deciles", comp_cte(), DECILES),
    "prj_canonicalise": sql(
        "SELECT cem_ecp, eco_sec, bgc_zone, bgc_subzon, bgc_vrt, sdec_1, sitemc_1, strct_1, seral_1,"
        " sdec_2, sitemc_2, strct_2, seral_2, sdec_3, sitemc_3, strct_3, seral_3, area FROM cpoly",
        f"cpoly AS (SELECT {CANON_POLY} FROM polygons)",
    ),
    "prj_range": sql("SELECT FID AS fid, ECO_SEC AS eco_sec, BGC_ZONE AS bgc_zone, BGC_SUBZON AS bgc_subzon,"
                     " BGC_VRT AS bgc_vrt FROM polygons"),
    "prj_drop": sql(f"SELECT fid, decile, sitemc, {to_unit('area_t', 'm2')} AS area_decile FROM deciles",
                    comp_cte(), DECILES),
    "prj_move_first": sql(f"SELECT {CANON_POLY} FROM polygons"),
    "flt_not_null": sql(f"SELECT fid, decile, ecosystem FROM (SELECT *, {LABEL} AS ecosystem FROM comp)"
                        " WHERE ecosystem IS NOT NULL", comp_cte()),
    "flt_outside_footprint": sql("SELECT FID AS fid, Location AS location FROM polygons WHERE Dist_Type IS NULL"),
    "flt_property_split": sql("SELECT FID AS fid, Dist_Type AS dist_type FROM polygons"
                              " WHERE Location = 'Marl Fen Property'"),
    "flt_positive_area": sql(f"SELECT fid, decile, {to_unit('area_t', 'm2')} AS area FROM comp WHERE area_t > 0",
                             comp_cte()),
    "flt_not_in_keep_null": sql(
        f"SELECT paz, bec_variant, ecosystem, strct, type, {to_unit('area_t', 'm2')} AS total_area FROM eun"
        " WHERE COALESCE(type IN ('Anthropogenic Areas', 'Water'), FALSE) = FALSE", *EU_ZONE),
    "ecosystem_label": sql(f"SELECT fid, decile, {LABEL} AS ecosystem FROM deciles", comp_cte(), DECILES),
    "ecosystem_unit_key": sql(f"SELECT fid, decile, {EUNIT} AS ecosystem_unit FROM"
                              f" (SELECT *, {LABEL} AS ecosystem FROM deciles)", comp_cte(), DECILES),
    "eu_area": sql(f"SELECT bec_variant, ecosystem, strct, {to_unit('area_t', 'm2')} AS total_area, n FROM eu",
                   *EU_ALL),
    "mc_area": sql(f"SELECT paz, bec_variant, ecosystem, {to_unit(STRICT_T, 'm2')} AS total_area, COUNT(*) AS n"
                   " FROM eu GROUP BY paz, bec_variant, ecosystem", *EU_ZONE),
    "jn_map_codes": sql(f"SELECT bec_variant, ecosystem, strct, unit, sort, site_series, site_series_name, type,"
                        f" {to_unit('area_t', 'm2')} AS total_area FROM eun", *EU_ALL),
    "jn_habitat_category": sql(f"SELECT bec_variant, ecosystem, strct, ecosystem_unit, bhc_raw AS bhc20,"
                               f" {to_unit('area_t', 'm2')} AS total_area FROM euc", *EU_ALL),
    "eu_summary": sql(f"SELECT {EU_REPORT_COLS}, {to_unit('area_t', 'm2')} AS total_area FROM eun", *EU_ALL),
    "eu_summary_by_zone": sql(f"SELECT paz, {EU_REPORT_COLS}, {to_unit('area_t', 'm2')} AS total_area FROM eun",
                              *EU_ZONE),
    "structural_class": sql(f"SELECT fid, decile, strct, {SCLASS} AS structural_class FROM deciles",
                            comp_cte(), DECILES),
    "after_class": sql(
        "SELECT paz, bec_variant, ecosystem, strct, structural_class, CASE"
        " WHEN paz = 'Transmission Line ROW' AND strct IN ('4','5','6','7') THEN 'Shrub'"
        " WHEN paz = 'Transmission Line ROW' AND (strct IS NULL OR strct IN ('1','2','3')) THEN structural_class"
        " ELSE 'Anthropogenic/Reservoir' END AS structural_class_after FROM eun", *EU_ZONE),
    "mc_wide": sql(f"SELECT bec_variant, ecosystem, {ZONE_CELLS} FROM eun WHERE ecosystem IS NOT NULL"
                   " GROUP BY bec_variant, ecosystem", *EU_ZONE),
    "mc_report": sql(
        f"SELECT m.sort, w.bec_variant, w.ecosystem, m.site_series, m.site_series_name, m.type, {ZONE_NAMES}"
        " FROM (SELECT *, bec_variant || ecosystem AS unit FROM mcw) w"
        " LEFT JOIN mc_names m ON w.unit IS NOT DISTINCT FROM m.unit",
        *EU_ZONE, f"mcw AS (SELECT bec_variant, ecosystem, {ZONE_CELLS} FROM eun WHERE ecosystem IS NOT NULL"
                  " GROUP BY bec_variant, ecosystem)"),
    "eu_after": sql(
        f"SELECT type, structural_class_after, {to_unit(STRICT_T, 'm2')} AS total_area FROM (SELECT *, CASE"
        " WHEN paz = 'Transmission Line ROW' AND strct IN ('4','5','6','7') THEN 'Shrub'"
        " WHEN paz = 'Transmission Line ROW' AND (strct IS NULL OR strct IN ('1','2','3')) THEN structural_class"
        " ELSE 'Anthropogenic/Reservoir' END AS structural_class_after FROM eun)"
        " WHERE COALESCE(type IN ('Anthropogenic Areas', 'Water'), FALSE) = FALSE"
        " AND structural_class_after <> 'Anthropogenic/Reservoir' GROUP BY type, structural_class_after", *EU_ZONE),
    "habitat_levels": sql("SELECT ecosystem_unit, bhc_raw, bhc20, bhc_level FROM euc", *EU_ALL),
    "bhc_rollup": sql(f"SELECT paz, bhc20, {to_unit(STRICT_T, 'ha')} AS total_area FROM euc GROUP BY paz, bhc20",
                      *EU_ZONE),
    "bhc_summary": sql(BHC_ROLLUP, *EU_ALL),
    "bhc_property": sql(BHC_ROLLUP, comp_cte(), "deciles AS (SELECT * FROM comp WHERE sitemc IS NOT NULL"
                        " AND location = 'Marl Fen Property' AND dist_type IS NULL)", MC_NAMES, CATS, *eu_ctes()),
    "bhc_other_properties": sql(BHC_ROLLUP, comp_cte(), "deciles AS (SELECT * FROM comp WHERE sitemc IS NOT NULL"
                                " AND location <> 'Marl Fen Property' AND dist_type IS NULL)", MC_NAMES, CATS,
                                *eu_ctes()),
    "xwalk_replace": sql("SELECT sitemc, COUNT(*) AS n FROM xd GROUP BY sitemc", *XWALK),
    "bhc_crosswalked": sql(BHC_ROLLUP, *XWALK, *eu_ctes(src="xd", bec="bgc_zone || bgc_subzon", eco="sitemc")),
    "compose_key": sql("SELECT fid, decile, eco FROM keyed", comp_cte("rcomp", "number"),
                       f"keyed AS (SELECT *, {ukey(RATING_PARTS_SQL)} AS eco FROM rcomp)"),
    "split_key": sql(f"SELECT fid, decile, eco, {split_cols('eco')} FROM keyed", comp_cte("rcomp", "number"),
                     f"keyed AS (SELECT *, {ukey(RATING_PARTS_SQL)} AS eco FROM rcomp)"),
    "na_text_to_null": sql(f"SELECT fid, decile, eco, {split_cols('eco', na_to_null=True)} FROM keyed",
                           comp_cte("rcomp", "number"), f"keyed AS (SELECT *, {ukey(RATING_PARTS_SQL)} AS eco FROM rcomp)"),
    "recode_rules": sql(
        "SELECT CEM_ECP AS cem_ecp,"
        " CASE WHEN STRCT_M1 = 'i' THEN '' WHEN STRCT_M1 = 's' THEN '' ELSE STRCT_M1 END AS strct_m_1,"
        " CASE WHEN STRCT_M3 = '3' THEN NULL ELSE STRCT_M3 END AS strct_m_3,"
        " CASE WHEN CEM_ECP = '87238' THEN '3' ELSE STRCT_S3 END AS strct_3 FROM polygons"),
    "jn_rating_nullsafe": sql(
        f"SELECT k.fid, k.decile, k.eco, {to_unit('k.area_t', 'm2')} AS area, r.BSEOW_LI AS rating FROM keyed k"
        " LEFT JOIN ratings r ON k.eco_sec IS NOT DISTINCT FROM r.ECO_SEC AND k.bgc_zone IS NOT DISTINCT FROM r.BGC_ZONE"
        " AND k.bgc_subzon IS NOT DISTINCT FROM r.BGC_SUBZON AND k.bgc_vrt IS NOT DISTINCT FROM r.BGC_VRT"
        " AND k.sitemc IS NOT DISTINCT FROM r.SITEMC_S AND k.site_ma IS NOT DISTINCT FROM r.SITE_MA"
        " AND k.site_mb IS NOT DISTINCT FROM r.SITE_MB AND k.strct IS NOT DISTINCT FROM r.STRCT_S"
        " AND k.strct_m IS NOT DISTINCT FROM r.STRCT_M AND k.seral IS NOT DISTINCT FROM r.SERAL",
        comp_cte("rcomp", "number"), f"keyed AS (SELECT *, {ukey(RATING_PARTS_SQL)} AS eco FROM rcomp)"),
    "jn_rating_composed": sql(
        f"SELECT k.fid, k.decile, k.eco, {to_unit('k.area_t', 'm2')} AS area, r.rating FROM keyed k"
        " LEFT JOIN rtab r ON k.eco = r.reco", *RATED_BASE[:3]),
    "whr_rate": sql(f"SELECT fid, decile, eco, {to_unit('area_t', 'm2')} AS area, rating FROM rated", *RATED_BASE),
    "whr_rate_revised": sql(f"SELECT fid, decile, eco, {to_unit('area_t', 'm2')} AS area, rating FROM rated",
                            *[c.replace("FROM ratings)", "FROM ratings_revised)") for c in RATED_BASE]),
    "whr_wide": sql(
        "SELECT fid, MAX(rating) FILTER (WHERE decile = '1') AS decile_1, MAX(rating) FILTER (WHERE decile = '2')"
        " AS decile_2, MAX(rating) FILTER (WHERE decile = '3') AS decile_3 FROM rated GROUP BY fid", *RATED_BASE),
    "whr_unmatched": sql(
        f"SELECT eco, area, {split_cols('eco')} FROM (SELECT eco, {to_unit(STRICT_T, 'm2')} AS area FROM rated"
        " WHERE area_t <> 0 AND rating IS NULL GROUP BY eco)", *RATED_BASE),
    "rating_area_all": sql(f"SELECT rating, {to_unit(STRICT_T, 'm2')} AS area_tot FROM rated GROUP BY rating",
                           *RATED_BASE),
    "rating_area_first": sql(f"SELECT rating, {to_unit(STRICT_T, 'm2')} AS area_tot FROM rated WHERE decile = '1'"
                             " GROUP BY rating", *RATED_BASE),
    "ecosystem_list": sql(
        "SELECT eco, " + ", ".join(f"{c} AS {n}" for c, n in zip(RATING_PARTS_SQL.split(", "), RATING_PART_NAMES))
        + f", {to_unit(STRICT_T, 'm2')} AS area FROM rated GROUP BY eco, {RATING_PARTS_SQL}", *RATED_BASE),
    "jn_rating_first_component": sql(
        f"SELECT w.cem_ecp, w.eco_1, r.rating FROM (SELECT CEM_ECP AS cem_ecp, {wide_key(1)} AS eco_1 FROM polygons) w"
        " LEFT JOIN rtab r ON w.eco_1 = r.reco", f"rtab AS (SELECT {RKEY} AS reco, BSEOW_LI AS rating FROM ratings)"),
    "whi_first_component": sql(
        f"SELECT w.cem_ecp, w.eco_1, w.eco_2, w.eco_3, r.rating FROM (SELECT CEM_ECP AS cem_ecp, {wide_key(1, True)} AS eco_1,"
        f" {wide_key(2, True)} AS eco_2, {wide_key(3, True)} AS eco_3 FROM rpoly) w LEFT JOIN rtab r ON w.eco_1 = r.reco",
        f"rtab AS (SELECT {RKEY_SITE} AS reco, BSEOW_LI AS rating FROM ratings)",
        "rpoly AS (SELECT * REPLACE ("
        " CASE WHEN STRCT_M1 = 'i' THEN '' WHEN STRCT_M1 = 's' THEN '' ELSE STRCT_M1 END AS STRCT_M1,"
        " CASE WHEN STRCT_M3 = '3' THEN NULL ELSE STRCT_M3 END AS STRCT_M3,"
        " CASE WHEN CEM_ECP = '87238' THEN '3' ELSE STRCT_S3 END AS STRCT_S3) FROM polygons)"),
    "parcel_area_wide": sql("SELECT pid AS parcel_id, footprint, not_footprint, footprint + not_footprint AS parcel_area"
                            " FROM parea", *PARCEL_CTES),
    "parcel_bhc_wide": sql("SELECT * FROM pbhc", *PARCEL_CTES),
    "parcel_report": sql("SELECT b.*, a.footprint, a.not_footprint, a.footprint + a.not_footprint AS parcel_area"
                         " FROM pbhc b LEFT JOIN parea a ON b.parcel_id IS NOT DISTINCT FROM a.pid", *PARCEL_CTES),
    "qa_frequencies": sql(QA_FREQ, f"cpoly AS (SELECT {CANON_POLY} FROM polygons)"),
    "qa_crosstab": sql("SELECT BGC_ZONE AS bgc_zone, COUNT(*) FILTER (WHERE BGC_SUBZON = 'mv') AS mv,"
                       " COUNT(*) FILTER (WHERE BGC_SUBZON = 'mw') AS mw FROM polygons"
                       " WHERE BGC_ZONE IS NOT NULL AND BGC_SUBZON IS NOT NULL GROUP BY BGC_ZONE"),
    "qa_total_area": sql("SELECT COUNT(*) AS n, CAST(CASE WHEN COUNT(AREA) = COUNT(*) THEN SUM(AREA) END AS DOUBLE)"
                         " / 10000.0 AS total_area FROM polygons"),
    "qa_area_conservation": sql(CONSERVATION, *EU_ALL),
    "qa_duplicate_keys": sql(
        "SELECT 'habitat_categories' AS \"check\", c.cat_unit AS key, c.n FROM (SELECT cat_unit, COUNT(*) AS n"
        " FROM cats GROUP BY cat_unit HAVING COUNT(*) > 1) c WHERE c.cat_unit IN (SELECT ecosystem_unit FROM eu)"
        " UNION ALL SELECT 'map_codes', m.unit, m.n FROM (SELECT unit, COUNT(*) AS n FROM mc_names GROUP BY unit"
        " HAVING COUNT(*) > 1) m WHERE m.unit IN (SELECT unit FROM eu)"
        " UNION ALL SELECT 'rated_fid_decile', CAST(fid AS VARCHAR) || '|' || decile, COUNT(*) FROM rated"
        " GROUP BY fid, decile HAVING COUNT(*) > 1", *EU_ALL, *RATED_BASE),
    "qa_share_sum": sql("SELECT CAST(COALESCE(SDEC_1,0) + COALESCE(SDEC_2,0) + COALESCE(SDEC_3,0) AS INTEGER)"
                        " AS share_sum, COUNT(*) AS n FROM polygons GROUP BY 1"),
    "src_typed_csv": sql(
        "SELECT CAST(FID AS VARCHAR) AS fid, cem_ecp, parcel_id, paz, dist_type, location, eco_sec, bgc_zone,"
        " bgc_subzon, bgc_vrt, CAST(area AS DOUBLE) AS area, "
        + ", ".join(f"sdec_{n}, site_{n}, sitemc_{n}, site_ma_{n}, site_mb_{n}, strct_{n}, strct_m_{n}, seral_{n}"
                    for n in (1, 2, 3)) + " FROM (SELECT " + CANON_POLY + " FROM polygons)"),
    "snk_csv_roundtrip": sql(
        "SELECT bec_variant, ecosystem, site_series_name, type, strct, NULLIF(structural_class, 'NA') AS structural_class,"
        f" {to_unit('area_t', 'ha')} AS total_area FROM eun", *EU_ALL),
    "src_header_offset": sql(
        "SELECT paz, bec_variant, ecosystem, site_series_name, type, strct, NULLIF(structural_class, 'NA')"
        f" AS structural_class, {to_unit('area_t', 'm2')} AS total_area FROM eun", *EU_ZONE),
    "qa_component_crosstabs": sql(" UNION ALL ".join(
        f"SELECT '{a}_x_{b}' AS \"table\", r.a AS \"row\", c.b AS col, COUNT(p.a) AS n FROM (SELECT DISTINCT {a} AS a FROM cpoly"
        f" WHERE {a} IS NOT NULL) r CROSS JOIN (SELECT DISTINCT {b} AS b FROM cpoly WHERE {b} IS NOT NULL) c"
        f" LEFT JOIN (SELECT {a} AS a, {b} AS b FROM cpoly) p ON p.a = r.a AND p.b = c.b GROUP BY r.a, c.b"
        for a, b in QA_PAIR_COLS), f"cpoly AS (SELECT {CANON_POLY} FROM polygons)"),
    "qa_pack": sql(" UNION ALL ".join(
        [f"SELECT 'code' AS kind, '{c}' AS tab, CAST({c} AS VARCHAR) AS row_value, NULL AS col_value, COUNT(*) AS n FROM cpoly"
         f" WHERE {c} IS NOT NULL GROUP BY {c}" for c in QA_COLS]
        + [f"SELECT 'pair', '{a}_x_{b}', {a}, {b}, COUNT(*) FROM cpoly WHERE {a} IS NOT NULL OR {b} IS NOT NULL GROUP BY {a}, {b}"
           for a, b in [("bgc_zone", "bgc_subzon"), *QA_PAIR_COLS]]
        + ["SELECT 'shares', 'share_sum', CAST(CAST(COALESCE(sdec_1,0) + COALESCE(sdec_2,0) + COALESCE(sdec_3,0) AS INTEGER) AS VARCHAR),"
           " NULL, COUNT(*) FROM cpoly GROUP BY 3", "SELECT 'total', 'total_area', NULL, NULL, COUNT(*) FROM cpoly"]),
        f"cpoly AS (SELECT {CANON_POLY} FROM polygons)"),
    "rating_area_revised": sql(f"SELECT rating, {to_unit(STRICT_T, 'm2')} AS area_tot FROM rated GROUP BY rating",
                               *[c.replace("FROM ratings)", "FROM ratings_revised)") for c in RATED_BASE]),
    "rate_job_totals": sql(" UNION ALL ".join(
        f"SELECT '{s}' AS stage, {to_unit(STRICT_T, 'm2')} AS total_area, {to_unit('SUM(area_t)', 'm2')} AS total_area_known,"
        f" COUNT(*) FILTER (WHERE area_t IS NULL) AS n_missing FROM {t}"
        for s, t in (("components", "keyed WHERE area_t > 0"), ("ecosystem_list", "keyed WHERE area_t > 0"), ("rated", "rated"))),
        *RATED_BASE),
    "src_csv_diagnostics": sql(
        "SELECT 'AREA' AS column_name, COUNT(*) FILTER (WHERE FID % 7 = 0) AS n_bad, FALSE AS absent FROM polygons"
        " UNION ALL SELECT 'SDEC_1', COUNT(*) FILTER (WHERE FID % 11 = 0), FALSE FROM polygons"
        " UNION ALL SELECT 'SDEC_2', 0, FALSE UNION ALL SELECT 'area_ha', NULL, TRUE"),
    "src_sheet_in_blocks": sql(
        "SELECT FID AS fid, CASE WHEN FID % 3 = 0 THEN 'seen \"' || FID || '\"' || chr(10) || 'then, again'"
        " WHEN FID % 5 = 0 THEN 'plain, text' END AS note, SITEMC_S1 AS sitemc FROM polygons"),
    "whr_wide_repeated": sql(
        "SELECT fid, MAX(rating) FILTER (WHERE decile = '1') AS decile_1, MAX(rating) FILTER (WHERE decile = '2')"
        " AS decile_2, MAX(rating) FILTER (WHERE decile = '3') AS decile_3 FROM rated GROUP BY fid", *REPEATED_BASE),
    "qa_duplicate_rated": sql(
        "SELECT 'rated_fid_decile' AS \"check\", CAST(fid AS VARCHAR) || '|' || decile AS key, COUNT(*) AS n FROM rated"
        " GROUP BY fid, decile HAVING COUNT(*) > 1", *REPEATED_BASE),
    "qa_rating_conservation": sql(" UNION ALL ".join(
        f"SELECT '{s}' AS stage, {to_unit(STRICT_T, 'm2')} AS total_area, {to_unit('SUM(area_t)', 'm2')} AS total_area_known,"
        f" COUNT(*) FILTER (WHERE area_t IS NULL) AS n_missing FROM {t}"
        for s, t in (("components", "keyed WHERE area_t > 0"), ("ecosystem_list", "keyed WHERE area_t > 0"), ("rated", "rated"))),
        *RATED_BASE),
    "jn_lookup_shuffled": sql("SELECT p.FID AS fid, p.CEM_ECP AS cem_ecp, t.p_brand, t.p_size FROM polygons p"
                              " LEFT JOIN part t ON p.CEM_ECP = CAST(t.p_partkey AS VARCHAR)"),
    "eu_area_double": sql(
        "SELECT bgc_zone || bgc_subzon || bgc_vrt AS bec_variant, ecosystem, strct,"
        " CASE WHEN COUNT(a) = COUNT(*) THEN SUM(a) END / 1000 AS total_area, COUNT(*) AS n FROM"
        f" (SELECT *, {LABEL} AS ecosystem, CAST(FLOOR(area * 4) AS DOUBLE) / 4 * 100 * sdec AS a FROM deciles)"
        " GROUP BY bgc_zone || bgc_subzon || bgc_vrt, ecosystem, strct", comp_cte(), DECILES),
    "eu_area_any_double": sql(
        "SELECT bgc_zone || bgc_subzon || bgc_vrt AS bec_variant, ecosystem, strct,"
        f" CASE WHEN COUNT(a) = COUNT(*) THEN {exact_total('a')} END / 1000 AS total_area, COUNT(*) AS n FROM"
        f" (SELECT *, {LABEL} AS ecosystem, {ODD_DOUBLE} * 100 * sdec AS a FROM deciles)"
        " GROUP BY bgc_zone || bgc_subzon || bgc_vrt, ecosystem, strct", comp_cte(), DECILES),
    "qa_total_area_any_double": sql(
        f"SELECT COUNT(*) AS n, CASE WHEN COUNT(a) = COUNT(*) THEN {exact_total('a')} END / 10000 AS total_area"
        f" FROM (SELECT {ODD_DOUBLE} AS a FROM polygons)"),
    "bhc_crosswalked_tem": sql(
        BHC_ROLLUP, "tem AS (" + TEM_SQL.replace("{polygons}", "polygons") + ")",
        "deciles AS (SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT Bgc_Zone AS bgc_zone, Bgc_Subzon AS bgc_subzon, SiteMC_S{n} AS sitemc, Strct_S{n} AS strct, Seral_{n} AS seral,"
            f" CAST(Area_ha * 1000000 AS BIGINT) * Sdec_{n} AS area_t FROM tem" for n in (1, 2, 3)) + ") WHERE sitemc IS NOT NULL)",
        *XWALK[2:], *eu_ctes(src="xd", bec="bgc_zone || bgc_subzon", eco="sitemc")),
}

ORACLE["prj_display_names"] = (
    'SELECT sort AS "Sort", bec_variant AS "BEC Variant", ecosystem AS "Ecosystem", site_series AS "Site Series",'
    ' site_series_name AS "Site Series Name", type AS "Type", dam AS "Dam", reservoir AS "Reservoir", tl AS "TL", hwy_29 AS "Hwy 29",'
    f' road AS "Road", quarry AS "Quarry", erosion_impact AS "Erosion Impact" FROM ({ORACLE["mc_report"]})')
