"""Registered queries: one Spark job per operator / domain job of the
inventory, each over the whole fixture built from the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame with
snake_case columns matching ``oracle.ORACLE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jobs
from .functions.area import to_unit
from .functions.classify import after_class, as_level, level_position, recode, structural_class
from .functions.keys import ecosystem_label, ecosystem_unit, split_key
from .functions.nulls import expr, lit, na_text_to_null_all, not_in_keep_missing
from .operators.aggregate import group_area
from .operators.lookup import lookup
from .operators.project import canonicalise, cols_between, move_first
from .operators.reshape import to_long
from .plans import ecosystems as eco
from .plans import parcels, qa, ratings
from .schema import CEM, NOT_FOOTPRINT, RATING_KEY_PARTS, RATING_KEY_PARTS_SITE, SPATIAL_RECODES, TEM, ZONE_COLUMNS
from .session import scratch_path
from .sources import files
from .sources.fixture import LOOKUP_ROWS, Fixture, load_fixture

MAP_ROWS = LOOKUP_ROWS["map_codes"]
CAT_ROWS = LOOKUP_ROWS["habitat_categories"]
RATING_ROWS = LOOKUP_ROWS["ratings"]
XWALK_ROWS = LOOKUP_ROWS["crosswalk"]
# code lists of the fixture, given so that no plan needs a job of its own
FOOTPRINT_CLASSES = ["Footprint", NOT_FOOTPRINT]
SUBZONES = ["mv", "mw"]
# blocks of a sheet that is read by block, about; from 16 KB to 32 MB each
SHEET_BLOCKS = 256


class Inputs:
    """The fixture of one scale factor with canonical polygons."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        fx: Fixture = load_fixture(spark, sf_dir)
        self.spark = spark
        self.sf_dir = sf_dir
        self.raw = fx.polygons
        self.polygons = canonicalise(fx.polygons, CEM)
        self.map_codes = fx.map_codes
        self.categories = fx.habitat_categories
        self.ratings = fx.ratings
        self.ratings_revised = fx.ratings_revised
        self.polygons_tem = canonicalise(fx.polygons_tem, TEM)
        self.crosswalk = fx.crosswalk

    def deciles(self, ids=(), **kw) -> DataFrame:
        return eco.components(self.polygons, ids=ids, **kw)

    def eu(self, by=()) -> DataFrame:
        return eco.eu_summary(self.deciles(ids=by), self.map_codes, by, map_rows=MAP_ROWS)

    def eu_cat(self, by=()) -> DataFrame:
        return eco.with_categories(self.eu(by), self.categories, CAT_ROWS)

    def rating_comps(self, positive_only=True) -> DataFrame:
        return ratings.rating_components(self.polygons, RATING_KEY_PARTS, positive_only)

    def rating_units(self) -> DataFrame:
        return ratings.rating_units(self.rating_comps(), RATING_KEY_PARTS)

    def rated_units(self) -> DataFrame:
        return ratings.rate(self.rating_units(), self.ratings, RATING_KEY_PARTS, rating_rows=RATING_ROWS)

    def rated(self, positive_only=True, mode="composed") -> DataFrame:
        return ratings.rate(self.rating_comps(positive_only), self.ratings, RATING_KEY_PARTS, mode,
                            rating_rows=RATING_ROWS)


_INPUTS: dict[tuple[int, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The (lazy) input plans of one session and scale factor, built once:
    a dataset handle reused by every report, like a user's session would."""
    key = (id(spark), sf_dir)
    cached = _INPUTS.get(key)
    if cached is None or cached.spark is not spark:
        cached = _INPUTS[key] = Inputs(spark, sf_dir)
    return cached


def _q(fn: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(inputs(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


LONG_FIELDS = ["sdec", "sitemc", "strct", "seral"]


# --- reshaping, projections, filters -------------------------------------

def deciles_long(i: Inputs):
    """RSH-1 / SC-3 / FLT-1: components as rows, empty ones dropped."""
    return to_long(i.polygons, ["fid"], LONG_FIELDS)


def apportion_area(i: Inputs):
    """PRJ-8: component area = share/10 x polygon area."""
    return i.deciles(ids=["fid"]).selectExpr("fid", "decile", f"{to_unit('area_t', 'm2')} AS area")


def prj_canonicalise(i: Inputs):
    """PRJ-1: pick and rename to canonical names."""
    keep = ["cem_ecp", "eco_sec", "bgc_zone", "bgc_subzon", "bgc_vrt", "area"] + [
        f"{f}_{n}" for n in (1, 2, 3) for f in LONG_FIELDS
    ]
    return canonicalise(i.raw, CEM, keep=keep)


def prj_range(i: Inputs):
    """PRJ-2: contiguous column range."""
    cols = ["FID", *cols_between(i.raw, "ECO_SEC", "BGC_VRT")]
    return i.raw.selectExpr(*[f"{c} AS {c.lower()}" for c in cols])


def prj_drop(i: Inputs):
    """PRJ-3: drop the polygon area after apportioning."""
    d = i.deciles(ids=["fid"]).selectExpr("fid", "decile", "sitemc", "area", f"{to_unit('area_t', 'm2')} AS area_decile")
    return d.drop("area")


def prj_move_first(i: Inputs):
    """PRJ-5: area first, everything else after."""
    return move_first(i.polygons, "area")


def flt_not_null(i: Inputs):
    """FLT-1: components with an ecosystem (all components reshaped first)."""
    d = to_long(i.polygons, ["fid"], ["sitemc", "seral"], drop_empty=None)
    return d.selectExpr("fid", "decile", f"{ecosystem_label()} AS ecosystem").filter("ecosystem IS NOT NULL")


def flt_outside_footprint(i: Inputs):
    """FLT-2: polygons outside the footprint."""
    return i.polygons.filter("dist_type IS NULL").select("fid", "location")


def flt_property_split(i: Inputs):
    """FLT-3: one property (missing location dropped)."""
    return i.polygons.filter(f"location = {lit('Marl Fen Property')}").select("fid", "dist_type")


def flt_positive_area(i: Inputs):
    """FLT-4: components with area > 0 (share 0 and missing share dropped)."""
    d = eco.components(i.polygons, ids=["fid"], drop_empty=False)
    return d.filter("area_t > 0").selectExpr("fid", "decile", f"{to_unit('area_t', 'm2')} AS area")


def flt_not_in_keep_null(i: Inputs):
    """FLT-5: type not excluded; a missing type is kept."""
    e = i.eu(by=["paz"]).filter(not_in_keep_missing("type", ["Anthropogenic Areas", "Water"]))
    return e.selectExpr("paz", "bec_variant", "ecosystem", "strct", "type", f"{to_unit('area_t', 'm2')} AS total_area")


# --- scalar functions ----------------------------------------------------

def ecosystem_label_q(i: Inputs):
    """SC-4: map code or code:seral."""
    return i.deciles(ids=["fid"]).selectExpr("fid", "decile", f"{ecosystem_label()} AS ecosystem")


def ecosystem_unit_key(i: Inputs):
    """SC-2 / SC-5: ecosystem + stage with NA pieces."""
    d = i.deciles(ids=["fid"]).selectExpr("fid", "decile", "strct", f"{ecosystem_label()} AS ecosystem")
    return d.selectExpr("fid", "decile", f"{ecosystem_unit()} AS ecosystem_unit")


def structural_class_q(i: Inputs):
    """SC-6: structural class from the stage (text compare)."""
    return i.deciles(ids=["fid"]).selectExpr("fid", "decile", "strct", f"{structural_class()} AS structural_class")


def after_class_q(i: Inputs):
    """SC-7 / SC-8: class after construction per zone."""
    e = i.eu(by=["paz"])
    return e.selectExpr("paz", "bec_variant", "ecosystem", "strct", "structural_class",
                        f"{after_class()} AS structural_class_after")


def habitat_levels(i: Inputs):
    """SC-12: habitat category as a fixed-level factor and its level."""
    e = lookup(i.eu(), eco.categories_table(i.categories), ["ecosystem_unit"], table_rows=CAT_ROWS)
    return e.selectExpr("ecosystem_unit", "bhc20 AS bhc_raw", f"{as_level('bhc20')} AS bhc20",
                        f"{level_position('bhc20')} AS bhc_level")


def compose_key_q(i: Inputs):
    """RSH-5: ten-part composed key, missing pieces as NA."""
    return i.rating_comps(positive_only=False).select("fid", "decile", "eco")


def _split(i: Inputs):
    k = i.rating_comps(positive_only=False)
    names = [p.lower() for p in RATING_KEY_PARTS]
    return k.selectExpr("fid", "decile", "eco", *[f"{c} AS {n}" for c, n in zip(split_key("eco", len(names)), names)])


def split_key_q(i: Inputs):
    """RSH-6: split the key on any run of non-alphanumerics."""
    return _split(i)


def na_text_to_null(i: Inputs):
    """SC-9: text NA -> missing across the split parts."""
    return na_text_to_null_all(_split(i), [p.lower() for p in RATING_KEY_PARTS])


def recode_rules(i: Inputs):
    """SC-11: conditional cell corrections."""
    return recode(i.polygons, SPATIAL_RECODES).select("cem_ecp", "strct_m_1", "strct_m_3", "strct_3")


# --- aggregation, lookups, EU jobs ---------------------------------------

def eu_area(i: Inputs):
    """AGG-1 / SC-1: strict area per BEC variant, ecosystem, stage."""
    e = eco.eu_units(i.deciles())
    return e.selectExpr("bec_variant", "ecosystem", "strct", f"{to_unit('area_t', 'm2')} AS total_area", "n")


def mc_area(i: Inputs):
    """AGG-2: roll-up of the zone EU rows by zone, variant, ecosystem."""
    g = group_area(i.eu(by=["paz"]), ["paz", "bec_variant", "ecosystem"])
    return g.selectExpr("paz", "bec_variant", "ecosystem", f"{to_unit('area_t', 'm2')} AS total_area", "n")


def jn_map_codes(i: Inputs):
    """JN-1 / JN-7: names by unit (null-safe), left-hand variant kept."""
    return i.eu().selectExpr("bec_variant", "ecosystem", "strct", "unit", "sort", "site_series", "site_series_name",
                             "type", f"{to_unit('area_t', 'm2')} AS total_area")


def jn_habitat_category(i: Inputs):
    """JN-2: category by ecosystem unit (fan-out on duplicate keys)."""
    e = lookup(i.eu(), eco.categories_table(i.categories), ["ecosystem_unit"], table_rows=CAT_ROWS)
    return e.selectExpr("bec_variant", "ecosystem", "strct", "ecosystem_unit", "bhc20",
                        f"{to_unit('area_t', 'm2')} AS total_area")


def eu_summary(i: Inputs):
    """D3: EU summary."""
    return eco.eu_report(i.eu())


def eu_summary_by_zone(i: Inputs):
    """D3 by project activity zone."""
    return eco.eu_report(i.eu(by=["paz"]), by=["paz"])


def mc_wide(i: Inputs):
    """RSH-2: zones to columns (absent zone -> missing column)."""
    rep = eco.mc_report(i.eu(by=["paz"]), i.map_codes, map_rows=MAP_ROWS, order=False)
    return rep.select("bec_variant", "ecosystem", *[c for _, c in ZONE_COLUMNS])


def mc_report(i: Inputs):
    """D4 / SRT-1: map-code table by zone, ordered by sort."""
    return eco.mc_report(i.eu(by=["paz"]), i.map_codes, map_rows=MAP_ROWS)


def eu_after(i: Inputs):
    """D5: after-construction area."""
    return eco.eu_after(i.eu(by=["paz"]))


def bhc_rollup(i: Inputs):
    """AGG-2 / PRJ-9: habitat categories per zone in ha."""
    return eco.bhc_summary(i.eu_cat(by=["paz"]), by=["paz"])


def bhc_summary(i: Inputs):
    """D6 (flagship): habitat-category area in ha, level order."""
    return eco.habitat_summary(i.polygons, i.map_codes, i.categories, map_rows=MAP_ROWS, cat_rows=CAT_ROWS)


def bhc_property(i: Inputs):
    """D7: one property outside the footprint."""
    p = eco.property_polygons(i.polygons)
    return eco.habitat_summary(p, i.map_codes, i.categories, map_rows=MAP_ROWS, cat_rows=CAT_ROWS)


def bhc_other_properties(i: Inputs):
    """D7: the other properties outside the footprint."""
    p = eco.property_polygons(i.polygons, negate=True)
    return eco.habitat_summary(p, i.map_codes, i.categories, map_rows=MAP_ROWS, cat_rows=CAT_ROWS)


def xwalk_replace(i: Inputs):
    """JN-5: old -> new map codes; unmatched become missing."""
    d = eco.crosswalked_components(i.polygons, i.crosswalk, xwalk_rows=XWALK_ROWS)
    return d.groupBy("sitemc").agg(expr("count(1) AS n"))


def bhc_crosswalked(i: Inputs):
    """D8: crosswalked habitat summary."""
    return eco.crosswalked_habitat_summary(i.polygons, i.crosswalk, i.map_codes, i.categories,
                                           xwalk_rows=XWALK_ROWS, map_rows=MAP_ROWS, cat_rows=CAT_ROWS)


# --- ratings -------------------------------------------------------------

def jn_rating_nullsafe(i: Inputs):
    """JN-3: rating on ten null-safe key parts, area not filtered."""
    return ratings.rated_rows(i.rated(positive_only=False, mode="nullsafe"))


def jn_rating_composed(i: Inputs):
    """JN-3: rating on the composed text key, area not filtered."""
    return ratings.rated_rows(i.rated(positive_only=False, mode="composed"))


def whr_rate(i: Inputs):
    """D1: rating per component with area > 0."""
    return ratings.rated_rows(i.rated())


def whr_rate_revised(i: Inputs):
    """D1b: the same job against the revised sheet."""
    r = ratings.rate(i.rating_comps(), i.ratings_revised, rating_rows=LOOKUP_ROWS["ratings_revised"])
    return ratings.rated_rows(r)


def whr_wide(i: Inputs):
    """RSH-4: one row per polygon, one rating column per component."""
    return ratings.rating_by_polygon(i.polygons, i.ratings, rating_rows=RATING_ROWS)


def whr_wide_repeated(i: Inputs):
    """RSH-4 where polygon ids repeat and a key stands twice in the sheet."""
    return ratings.rating_by_polygon(repeated(i), twice(i.ratings))


def repeated(i: Inputs) -> DataFrame:
    """The polygons, every 97th with the id of another one."""
    return i.polygons.selectExpr("if(fid % 97 = 0, fid - 1, fid) AS fid", *[c for c in i.polygons.columns if c != "fid"])


def twice(sheet: DataFrame) -> DataFrame:
    """A rating sheet whose water keys stand twice, the second time rated W."""
    again = sheet.filter("SITEMC_S = 'OW'").selectExpr(*["'W' AS BSEOW_LI" if c == "BSEOW_LI" else c for c in sheet.columns])
    return sheet.unionByName(again)


def whr_unmatched(i: Inputs):
    """JN-8: keys with no rating, area, key split."""
    return ratings.unmatched(i.rated_units())


def rating_area_all(i: Inputs):
    """AGG-7: area per rating, all components."""
    return ratings.rating_area(i.rated_units())


def rating_area_first(i: Inputs):
    """AGG-8: area per rating, first component."""
    return ratings.rating_area(i.rated_units(), first_only=True)


def ecosystem_list(i: Inputs):
    """AGG-6: distinct composed keys with area."""
    return ratings.ecosystem_list(i.rating_units())


def jn_rating_first_component(i: Inputs):
    """JN-4: rating of component 1 on the wide table."""
    r = ratings.first_component_rating(i.polygons, i.ratings, recodes=None, rating_rows=RATING_ROWS)
    return r.select("cem_ecp", "eco_1", "rating")


def whi_first_component(i: Inputs):
    """D11: cleaned modifiers, three eleven-part keys, component-1 rating."""
    return ratings.first_component_rating(i.polygons, i.ratings, RATING_KEY_PARTS_SITE, rating_rows=RATING_ROWS)


# --- parcels -------------------------------------------------------------

def parcel_area_wide(i: Inputs):
    """RSH-3 / RSH-7 / SC-10: footprint split per parcel."""
    return parcels.parcel_area(parcels.parcel_units(i.polygons), FOOTPRINT_CLASSES)


def parcel_bhc_wide(i: Inputs):
    """RSH-3: habitat categories per parcel outside the footprint."""
    return parcels.parcel_habitat(parcels.parcel_units(i.polygons), i.map_codes, i.categories,
                                  map_rows=MAP_ROWS, cat_rows=CAT_ROWS)


def parcel_report(i: Inputs):
    """D9 / JN-6: parcel categories joined to the footprint split."""
    return parcels.parcel_report(i.polygons, i.map_codes, i.categories, FOOTPRINT_CLASSES, map_rows=MAP_ROWS,
                                 cat_rows=CAT_ROWS)


# --- QA ------------------------------------------------------------------

def qa_frequencies(i: Inputs):
    """AGG-4: code frequencies of twelve columns in one pass."""
    return qa.code_frequencies(i.polygons)


def qa_crosstab(i: Inputs):
    """AGG-5: zone x subzone counts, zero cells shown."""
    return qa.zone_crosstab(i.polygons, SUBZONES)


def qa_total_area(i: Inputs):
    """AGG-3: polygon count and area control total (ha)."""
    return qa.total_area(i.polygons)


def qa_area_conservation(i: Inputs):
    """JN-9: area totals before and after each lookup (one scan)."""
    return qa.lookup_conservation(i.polygons, i.map_codes, i.categories, map_rows=MAP_ROWS, cat_rows=CAT_ROWS)


def qa_duplicate_keys(i: Inputs):
    """JN-9 / RSH-4: lookup keys that multiply rows; repeated rated keys."""
    keys = qa.duplicate_lookup_keys(eco.eu_units(i.deciles()), [
        ("habitat_categories", eco.categories_table(i.categories), "ecosystem_unit"),
        ("map_codes", eco.names_table(i.map_codes), "unit")])
    return keys.unionByName(qa.duplicate_rated(i.polygons, i.ratings, "rated_fid_decile", rating_rows=RATING_ROWS))


def qa_duplicate_rated(i: Inputs):
    """JN-9: repeated rated components where ids and sheet keys repeat."""
    return qa.duplicate_rated(repeated(i), twice(i.ratings), "rated_fid_decile")


def qa_pack(i: Inputs):
    """D10: all QA counts from one scan."""
    return qa.pack(i.polygons, qa.QA_FIELDS).selectExpr("kind", "`table` AS tab", "`row` AS row_value", "col AS col_value", "n")


def qa_component_crosstabs(i: Inputs):
    """AGG-5 / D10: map code x seral and stage x modifier per component."""
    return qa.component_crosstabs(i.polygons)


def qa_rating_conservation(i: Inputs):
    """AGG-3: control totals of the rating job."""
    return qa.rating_conservation(i.rating_units(), i.rated_units())


def jn_lookup_shuffled(i: Inputs):
    """JN-1: a lookup above the broadcast bound (joined by shuffle)."""
    part = i.spark.read.parquet(f"{i.sf_dir}/part.parquet")
    table = part.selectExpr("CAST(p_partkey AS STRING) AS cem_ecp", "p_brand", "p_size")
    return lookup(i.polygons.select("fid", "cem_ecp"), table, ["cem_ecp"], max_rows=10)


def eu_area_double(i: Inputs):
    """AGG-1 on areas that arrive as doubles (quarter square metres)."""
    p = i.polygons.selectExpr(*[c for c in i.polygons.columns if c != "area"], "CAST(floor(area * 4) AS DOUBLE) / 4D AS area")
    e = eco.eu_units(eco.components(p))
    return e.selectExpr("bec_variant", "ecosystem", "strct", f"{to_unit('area_t', 'm2')} AS total_area", "n")


ODD_FACTOR = 0.7310585786300049


def odd_doubles(i: Inputs) -> DataFrame:
    """The polygons with areas that are no round numbers in any unit."""
    return i.polygons.selectExpr(*[c for c in i.polygons.columns if c != "area"], f"CAST(area AS DOUBLE) * {ODD_FACTOR!r}D AS area")


def eu_area_any_double(i: Inputs):
    """AGG-1 on arbitrary doubles: the same total for any order of the rows."""
    e = eco.eu_units(eco.components(odd_doubles(i)))
    return e.selectExpr("bec_variant", "ecosystem", "strct", f"{to_unit('area_t', 'm2')} AS total_area", "n")


def qa_total_area_any_double(i: Inputs):
    """AGG-3 on arbitrary doubles."""
    return qa.total_area(odd_doubles(i))


def bhc_crosswalked_tem(i: Inputs):
    """D8 on a terrestrial-map workbook: its spelling, hectares, two-part variant."""
    return eco.crosswalked_habitat_summary(i.polygons_tem, i.crosswalk, i.map_codes, i.categories,
                                           xwalk_rows=XWALK_ROWS, map_rows=MAP_ROWS, cat_rows=CAT_ROWS)


def rating_area_revised(i: Inputs):
    """AGG-7 / D1b: area per rating of the revised sheet."""
    units = ratings.rate(i.rating_units(), i.ratings_revised, RATING_KEY_PARTS, rating_rows=LOOKUP_ROWS["ratings_revised"])
    return ratings.rating_area(units)


def rate_job_totals(i: Inputs):
    """JN-9 / AGG-3: control totals that the rating job takes while it writes."""
    reports = jobs.rate_job(i.polygons, i.ratings)
    for name in ("rated", "ecosystem_list"):
        reports[name].write.format("noop").mode("overwrite").save()
    jobs.release_shared()
    return reports["control_totals"]()


def prj_display_names(i: Inputs):
    """PRJ-7: the map-code table under its printed headers."""
    return jobs.with_display_names(mc_report(i))


def qa_share_sum(i: Inputs):
    """D10: polygons per share total."""
    return qa.share_sums(i.polygons)


# --- sources and sinks ---------------------------------------------------

def src_typed_csv(i: Inputs):
    """SRC-1: polygons exported as CSV, read back typed, canonicalised."""
    path = scratch_path(i.spark, "polygons-csv")
    files.write_csv(i.raw, path)
    types = {"SDEC_1": "int", "SDEC_2": "int", "SDEC_3": "int", "AREA": "double"}
    back = files.read_typed_csv(i.spark, path, types)
    return canonicalise(back, CEM)


def snk_csv_roundtrip(i: Inputs):
    """SNK-1: EU summary written as CSV (NA, no exponent), read as text."""
    path = scratch_path(i.spark, "eu-csv")
    files.write_csv(eco.eu_report(i.eu(), unit="ha"), path)
    return files.read_typed_csv(i.spark, path, {"total_area": "double"})


def src_header_offset(i: Inputs):
    """SRC-3: a report sheet with title lines above its header."""
    path = scratch_path(i.spark, "eu-sheet")
    rep = eco.eu_report(i.eu(by=["paz"]), by=["paz"])
    files.write_sheet(rep, path, ["Ecosystem units by project activity zone", "area in m2"],
                      sort_by=["paz", "bec_variant", "ecosystem", "strct"])
    return files.read_sheet(i.spark, path, skip=2, types={"total_area": "double"})


def src_csv_diagnostics(i: Inputs):
    """SRC-1: cells of typed columns that hold something else, and absent typed
    columns, counted while the table is read."""
    path = scratch_path(i.spark, "odd-csv")
    odd = {"AREA": "if(FID % 7 = 0, 'unknown', CAST(AREA AS STRING))", "SDEC_1": "if(FID % 11 = 0, 'ten', CAST(SDEC_1 AS STRING))"}
    files.write_csv(i.raw.selectExpr(*[f"{odd[c]} AS {c}" if c in odd else c for c in i.raw.columns]), path)
    seen = files.ReadReport()
    table = files.read_typed_csv(i.spark, path, {"SDEC_1": "int", "SDEC_2": "int", "AREA": "double", "Area_ha": "double"}, seen)
    table.write.format("noop").mode("overwrite").save()
    rows = [(c, n, False) for c, n in seen.bad_cells.items()] + [(c, None, True) for c in seen.absent]
    return i.spark.createDataFrame(rows, "column_name string, n_bad bigint, absent boolean")


def src_sheet_in_blocks(i: Inputs):
    """SRC-3: a sheet whose cells hold line breaks and quotes, read by several
    tasks."""
    path = scratch_path(i.spark, "notes-sheet")
    note = "CASE WHEN FID % 3 = 0 THEN concat('seen \"', FID, '\"\nthen, again') WHEN FID % 5 = 0 THEN 'plain, text' END"
    files.write_sheet(i.raw.selectExpr("FID AS fid", f"{note} AS note", "SITEMC_S1 AS sitemc"), path, ["Notes", "on polygons"], sort_by=["fid"])
    # small blocks for small sheets too, but no more blocks (each a task and a file) than several hundred
    size = i.spark.read.format("binaryFile").load(path).selectExpr("sum(length)").first()[0] or 0
    block = min(max(size // SHEET_BLOCKS, 16 << 10), 32 << 20)
    old = {k: i.spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        i.spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        i.spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return files.read_sheet(i.spark, path, skip=2, types={"fid": "bigint"})
    finally:
        for k, v in old.items():
            i.spark.conf.set(k, v)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _q(fn)
    for name, fn in {
        "deciles_long": deciles_long,
        "apportion_area": apportion_area,
        "prj_canonicalise": prj_canonicalise,
        "prj_range": prj_range,
        "prj_drop": prj_drop,
        "prj_move_first": prj_move_first,
        "flt_not_null": flt_not_null,
        "flt_outside_footprint": flt_outside_footprint,
        "flt_property_split": flt_property_split,
        "flt_positive_area": flt_positive_area,
        "flt_not_in_keep_null": flt_not_in_keep_null,
        "ecosystem_label": ecosystem_label_q,
        "ecosystem_unit_key": ecosystem_unit_key,
        "eu_area": eu_area,
        "mc_area": mc_area,
        "jn_map_codes": jn_map_codes,
        "jn_habitat_category": jn_habitat_category,
        "eu_summary": eu_summary,
        "eu_summary_by_zone": eu_summary_by_zone,
        "structural_class": structural_class_q,
        "after_class": after_class_q,
        "mc_wide": mc_wide,
        "mc_report": mc_report,
        "eu_after": eu_after,
        "habitat_levels": habitat_levels,
        "bhc_rollup": bhc_rollup,
        "bhc_summary": bhc_summary,
        "bhc_property": bhc_property,
        "bhc_other_properties": bhc_other_properties,
        "xwalk_replace": xwalk_replace,
        "bhc_crosswalked": bhc_crosswalked,
        "compose_key": compose_key_q,
        "split_key": split_key_q,
        "na_text_to_null": na_text_to_null,
        "recode_rules": recode_rules,
        "jn_rating_nullsafe": jn_rating_nullsafe,
        "jn_rating_composed": jn_rating_composed,
        "whr_rate": whr_rate,
        "whr_rate_revised": whr_rate_revised,
        "whr_wide": whr_wide,
        "whr_wide_repeated": whr_wide_repeated,
        "whr_unmatched": whr_unmatched,
        "rating_area_all": rating_area_all,
        "rating_area_first": rating_area_first,
        "ecosystem_list": ecosystem_list,
        "jn_rating_first_component": jn_rating_first_component,
        "whi_first_component": whi_first_component,
        "parcel_area_wide": parcel_area_wide,
        "parcel_bhc_wide": parcel_bhc_wide,
        "parcel_report": parcel_report,
        "qa_frequencies": qa_frequencies,
        "qa_crosstab": qa_crosstab,
        "qa_total_area": qa_total_area,
        "qa_area_conservation": qa_area_conservation,
        "qa_duplicate_keys": qa_duplicate_keys,
        "qa_share_sum": qa_share_sum,
        "qa_duplicate_rated": qa_duplicate_rated,
        "qa_pack": qa_pack,
        "rating_area_revised": rating_area_revised,
        "rate_job_totals": rate_job_totals,
        "prj_display_names": prj_display_names,
        "src_csv_diagnostics": src_csv_diagnostics,
        "src_sheet_in_blocks": src_sheet_in_blocks,
        "qa_component_crosstabs": qa_component_crosstabs,
        "qa_rating_conservation": qa_rating_conservation,
        "jn_lookup_shuffled": jn_lookup_shuffled,
        "eu_area_double": eu_area_double,
        "eu_area_any_double": eu_area_any_double,
        "qa_total_area_any_double": qa_total_area_any_double,
        "bhc_crosswalked_tem": bhc_crosswalked_tem,
        "src_typed_csv": src_typed_csv,
        "snk_csv_roundtrip": snk_csv_roundtrip,
        "src_header_offset": src_header_offset,
    }.items()
}
