"""File-to-report jobs, one per family of the analysed scripts.

Each job reads a polygon file (parquet or CSV, in a source spelling), the
lookup sheets it needs (CSV with an optional header offset, or parquet),
runs the plans of ``ecotally.plans`` and writes its reports (CSV with ``NA``
and no exponents, or parquet) under ``out``: one folder per report in a new
version, which the manifest names when all are written.

    python -m ecotally.jobs habitat --polygons p.parquet --map-codes mc.csv \\
        --map-codes-skip 1 --categories bhc.csv --categories-skip 3 --out out/

Jobs: ``zones`` (EU by zone, map-code table, after table), ``habitat`` (EU
summary + habitat categories), ``property`` (the same for one property, or
all others, outside the footprint), ``crosswalk`` (old -> new codes first,
zone+subzone variant), ``parcels`` (footprint split and categories per
parcel), ``rate`` (habitat ratings and their reports), ``whi`` (rating of the
first component on the wide table, EU summary in ha over all components) and
``qa`` (frequencies, crosstab, totals, share sums).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions.area import to_unit
from .operators.project import canonicalise
from .plans import ecosystems as eco
from .plans import parcels, qa, ratings
from .schema import DISPLAY_NAMES, MARL_FEN, RATING_KEY_PARTS, RATING_KEY_PARTS_SITE, SOURCES, ZONE_LABELS
from .sources import commit, files


def read_polygons(spark: SparkSession, path: str, spelling: str = "cem", fmt: str = "parquet",
                  report: files.ReadReport | None = None) -> DataFrame:
    """Polygon table in canonical names.  CSV: text by default, shares int,
    area double (as the source readers declare them); ``report`` counts the
    cells that aren't."""
    s = SOURCES[spelling]
    if fmt == "csv":
        types = {s.polygon["area"]: "double", **{s.component["sdec"].format(n=n): "int" for n in (1, 2, 3)}}
        raw = files.read_typed_csv(spark, path, types, report)
    else:
        raw = spark.read.parquet(path)
    return canonicalise(raw, s)


def read_sheet(spark: SparkSession, path: str | None, skip: int = 0) -> DataFrame | None:
    """A lookup sheet: parquet, or CSV whose header is on line ``skip + 1``."""
    if path is None:
        return None
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return files.read_sheet(spark, path, skip=skip) if skip else files.read_typed_csv(spark, path)


def shared(df: DataFrame) -> DataFrame:
    """Mark a unit-level aggregate that several reports of a job read (one row
    per unit, or per unit and parcel): Spark keeps it after the first
    report computes it (memory, then disk; lost parts are recomputed from
    lineage), so the polygons are scanned once per job.  ``write_reports``
    releases it."""
    _SHARED.append(df.persist())
    return df


_SHARED: list[DataFrame] = []


def release_shared() -> None:
    while _SHARED:
        _SHARED.pop().unpersist()


def zones_job(polygons, map_codes, unit="m2") -> dict[str, DataFrame]:
    eu = shared(eco.eu_summary(eco.components(polygons, ids=["paz"]), map_codes, by=["paz"]))
    return {
        "eu_by_zone": eco.eu_report(eu, by=["paz"], unit=unit),
        "map_codes_by_zone": eco.mc_report(eu, map_codes, unit=unit),
        "eu_after": eco.eu_after(eu, unit=unit),
    }


def habitat_job(polygons, map_codes, categories, eu_unit="m2", unit="ha") -> dict[str, DataFrame]:
    eu = shared(eco.with_categories(eco.eu_summary(eco.components(polygons), map_codes), categories))
    report = eu.selectExpr(*eco.EU_REPORT, "ecosystem_unit", "bhc20", f"{to_unit('area_t', eu_unit)} AS total_area")
    return {"eu": report, "habitat_summary": eco.bhc_summary(eu, unit=unit)}


def property_job(polygons, map_codes, categories, location=MARL_FEN, negate=False, **kw) -> dict[str, DataFrame]:
    return habitat_job(eco.property_polygons(polygons, location, negate), map_codes, categories, **kw)


def crosswalk_job(polygons, xwalk, map_codes, categories, unit="ha") -> dict[str, DataFrame]:
    d = eco.crosswalked_components(polygons, xwalk)
    eu = shared(eco.with_categories(eco.eu_summary(d, map_codes, bec_parts=2, ecosystem="sitemc"), categories))
    report = eu.selectExpr(*eco.EU_REPORT, "ecosystem_unit", "bhc20", f"{to_unit('area_t', unit)} AS total_area")
    return {"eu": report, "habitat_summary": eco.bhc_summary(eu, unit=unit)}


def parcels_job(polygons, map_codes, categories, classes: Sequence[str] | None = None, unit="ha"):
    units = shared(parcels.parcel_units(polygons))
    classes = classes or parcels.footprint_classes(units)
    return {
        "parcel_area": parcels.parcel_area(units, classes, unit),
        "parcel_habitat": parcels.parcel_report_from_units(units, map_codes, categories, classes, unit),
    }


def rate_job(polygons, rating_sheet, value=ratings.RATING_VALUE, revised=None) -> dict[str, DataFrame | Callable[[], DataFrame]]:
    """The rating reports on the ten-part key.  Rows per component and per
    polygon come straight from the polygons, by lookups on the rows; the area
    reports share one aggregate per key and component.  With a ``revised``
    sheet the area reports use it, the rows the first one.  Control totals are
    taken while the reports are written."""
    parts = RATING_KEY_PARTS
    comps, at_comps = qa.observed(ratings.rating_components(polygons, parts), "components")
    rated, at_rated = qa.observed(ratings.rate(comps, rating_sheet, parts, value=value), "rated")
    units = shared(ratings.rating_units(ratings.rating_components(polygons, parts), parts))
    keys, at_keys = qa.observed(ratings.ecosystem_keys(units, parts), "ecosystem_list")
    rated_units = ratings.rate(units, rating_sheet if revised is None else revised, parts, value=value)
    stages = [("components", at_comps), ("ecosystem_list", at_keys), ("rated", at_rated)]
    return {
        "rated": ratings.rated_rows(rated),
        "rating_by_polygon": ratings.rating_by_polygon(polygons, rating_sheet, parts, value),
        "unmatched": ratings.unmatched(rated_units, parts),
        "area_by_rating": ratings.rating_area(rated_units),
        "area_by_rating_first": ratings.rating_area(rated_units, first_only=True),
        "ecosystem_list": ratings.key_report(keys, parts),
        "control_totals": lambda: qa.observed_totals(polygons.sparkSession, stages),
    }


def whi_job(polygons, rating_sheet, map_codes, value=ratings.RATING_VALUE, eu_unit="ha") -> dict[str, DataFrame]:
    """First-component rating on the eleven-part key (with the site series)."""
    first = ratings.first_component_rating(polygons, rating_sheet, RATING_KEY_PARTS_SITE, value=value)
    eu = eco.eu_summary(eco.components(polygons, drop_empty=False), map_codes)
    return {"first_component_rating": first, "eu_summary": eco.eu_report(eu, unit=eu_unit)}


def qa_job(polygons) -> dict[str, DataFrame]:
    """All QA tables from one scan."""
    return qa.pack_reports(shared(qa.pack(polygons)))


def df_labels(df: DataFrame) -> dict[str, str]:
    """Printed headers of columns made of category values: the values
    themselves, kept in the columns' metadata."""
    return {f.name: f.metadata["label"] for f in df.schema.fields if f.metadata and "label" in f.metadata}


def with_display_names(df: DataFrame) -> DataFrame:
    """Report columns under their printed headers."""
    names = {**DISPLAY_NAMES, **ZONE_LABELS, **df_labels(df)}
    out, seen = [], set()
    for c in df.columns:
        label = names.get(c, c)
        label = c if label.lower() in seen else label  # a sheet can't hold two headers of one name
        seen.add(label.lower())
        out.append(label)
    return df.toDF(*out)


def write_reports(reports: dict[str, DataFrame | Callable[[], DataFrame]], out: str, fmt: str = "csv") -> list[str]:
    """Write every report under its printed headers, all or none: they go to
    a new version folder below ``out``, and only when the last one is written
    does the manifest name it (``sources.commit``).  A report given as a
    function is made after those before it are written.  Then the job's
    shared aggregates are released."""
    paths = {}
    spark = None
    try:
        version = commit.new_version()
        for name, df in reports.items():
            df = with_display_names(df() if callable(df) else df)
            spark = df.sparkSession
            paths[name] = commit.version_path(out, version, name)
            if fmt == "csv":
                files.write_csv(df, paths[name])
            else:
                df.write.parquet(paths[name])
        if spark is not None:
            commit.publish(spark, out, version, list(reports), fmt)
    finally:
        release_shared()
    return list(paths.values())


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    ap = argparse.ArgumentParser(prog="ecotally.jobs", description=__doc__.split("\n\n")[0])
    ap.add_argument("job", choices=["zones", "habitat", "property", "crosswalk", "parcels", "rate", "whi", "qa"])
    ap.add_argument("--polygons", required=True)
    ap.add_argument("--polygons-format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--spelling", choices=sorted(SOURCES), default="cem")
    for sheet in ("map-codes", "categories", "ratings", "ratings-revised", "crosswalk"):
        ap.add_argument(f"--{sheet}")
        ap.add_argument(f"--{sheet}-skip", type=int, default=0)
    ap.add_argument("--location", default=MARL_FEN)
    ap.add_argument("--other-properties", action="store_true")
    ap.add_argument("--eu-unit", choices=["m2", "ha"], default=None,
                    help="unit of EU tables (default m2; ha for the whi job)")
    ap.add_argument("--unit", choices=["m2", "ha"], default="ha", help="unit of habitat / parcel summaries")
    ap.add_argument("--out", required=True)
    ap.add_argument("--out-format", choices=["csv", "parquet"], default="csv")
    a = ap.parse_args(argv)

    spark = spark or SparkSession.builder.appName(f"ecotally-{a.job}").getOrCreate()
    seen = files.ReadReport()
    p = read_polygons(spark, a.polygons, a.spelling, a.polygons_format, seen)
    mc = read_sheet(spark, a.map_codes, a.map_codes_skip)
    cats = read_sheet(spark, a.categories, a.categories_skip)
    rat = read_sheet(spark, a.ratings, a.ratings_skip)
    revised = read_sheet(spark, a.ratings_revised, a.ratings_revised_skip)
    xw = read_sheet(spark, a.crosswalk, a.crosswalk_skip)
    eu_unit = a.eu_unit or "m2"
    reports = {
        "zones": lambda: zones_job(p, mc, unit=eu_unit),
        "habitat": lambda: habitat_job(p, mc, cats, eu_unit=eu_unit, unit=a.unit),
        "property": lambda: property_job(p, mc, cats, a.location, a.other_properties, eu_unit=eu_unit, unit=a.unit),
        "crosswalk": lambda: crosswalk_job(p, xw, mc, cats, unit=a.unit),
        "parcels": lambda: parcels_job(p, mc, cats, unit=a.unit),
        "rate": lambda: rate_job(p, rat, revised=revised),
        "whi": lambda: whi_job(p, rat, mc, eu_unit=a.eu_unit or "ha"),
        "qa": lambda: qa_job(p),
    }[a.job]()
    paths = write_reports(reports, a.out, a.out_format)
    if a.polygons_format == "csv":
        for line in seen.warnings():
            print(f"warning: {a.polygons}: {line}", file=sys.stderr)
    return paths


if __name__ == "__main__":
    main()
