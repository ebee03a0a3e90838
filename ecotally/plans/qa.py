"""QA pack (D10): code frequencies, crosstabs, area control totals,
duplicate lookup keys and share sums — each one pass with partial
aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation

from ..functions.area import to_unit
from ..functions.nulls import expr, ident, lit, strict_sum, total, type_of
from ..operators.aggregate import crosstab, crosstabs, frequencies, pair_cells, with_zero_cells
from ..operators.reshape import NUMBER_TAGS
from ..schema import NA_TEXT, RATING_KEY_PARTS, wide

QA_FIELDS = ("sdec", "sitemc", "seral", "strct")
# one-way and two-way tables the source scripts print per component
QA_ALL_FIELDS = ("sdec", "sitemc", "seral", "strct", "site_ma", "site_mb", "strct_m")
SHARE_SUM = " + ".join(f"coalesce({wide('sdec', n)}, 0)" for n in (1, 2, 3))
QA_PAIRS = (("sitemc", "seral"), ("strct", "strct_m"))


def code_frequencies(polygons: DataFrame, fields: Sequence[str] = QA_FIELDS) -> DataFrame:
    cols = [wide(f, n) for n in (1, 2, 3) for f in fields if wide(f, n) in polygons.columns]
    return frequencies(polygons, cols)


def zone_crosstab(polygons: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    return crosstab(polygons, "bgc_zone", "bgc_subzon", values)


def component_pairs(polygons: DataFrame, pairs=QA_PAIRS) -> list[tuple[str, str]]:
    return [(wide(a, n), wide(b, n)) for a, b in pairs for n in (1, 2, 3)
            if wide(a, n) in polygons.columns and wide(b, n) in polygons.columns]


def component_crosstabs(polygons: DataFrame, pairs=QA_PAIRS) -> DataFrame:
    """Per component, map code x seral and stage x structural modifier (pairs
    whose columns the source has), all in one scan and in long form: (table,
    row, col, n), empty cells shown."""
    return crosstabs(polygons, component_pairs(polygons, pairs))


ZONE_PAIR = ("bgc_zone", "bgc_subzon")


def pack(polygons: DataFrame, fields: Sequence[str] = QA_ALL_FIELDS, pairs=QA_PAIRS) -> DataFrame:
    """Everything the QA tables count, in one scan and one aggregate: each
    polygon gives a row for every table, tagged with its ``kind`` (``code``,
    ``pair``, ``shares``, ``total``); the partial aggregate leaves one row a
    task for each distinct code, pair and share sum."""
    cell = lambda kind, table, row="NULL", col="NULL", area="NULL": (
        f"named_struct('kind', {lit(kind)}, 'table', {table}, 'row', CAST({row} AS STRING), 'col', CAST({col} AS STRING), 'area', {area})")
    cols = [wide(f, n) for n in (1, 2, 3) for f in fields if wide(f, n) in polygons.columns]
    cells = [cell("code", lit(c), ident(c)) for c in cols]
    cells += [cell("pair", *x) for x in pair_cells([ZONE_PAIR, *component_pairs(polygons, pairs)])]
    cells += [cell("shares", lit("share_sum"), SHARE_SUM), cell("total", lit("total_area"), area=ident("area"))]
    long = polygons.selectExpr(f"inline(array({', '.join(cells)}))").filter("kind = 'total' OR `row` IS NOT NULL OR col IS NOT NULL")
    return long.groupBy("kind", "table", "row", "col").agg(
        expr("count(1) AS n"), expr(f"{strict_sum('area', type_of(polygons, 'area'))} AS area"))


def pack_reports(packed: DataFrame, unit: str = "ha") -> dict[str, DataFrame]:
    """The QA tables of a ``pack``."""
    div = float({"m2": 1, "ha": 10000}[unit])
    pairs = packed.filter("kind = 'pair'").select("table", "row", "col", "n")
    zone = lit("_x_".join(ZONE_PAIR))
    return {
        "frequencies": packed.filter("kind = 'code'").selectExpr("`table` AS column", "`row` AS value", "n"),
        "zone_crosstab": with_zero_cells(pairs.filter(f"`table` = {zone}")),
        "component_crosstabs": with_zero_cells(pairs.filter(f"`table` <> {zone}")),
        "total_area": packed.filter("kind = 'total'").agg(
            expr("coalesce(sum(n), 0L) AS n"), expr(f"CAST(max(area) AS DOUBLE) / {div!r}D AS total_area")),
        "share_sums": packed.filter("kind = 'shares'").selectExpr("CAST(`row` AS INT) AS share_sum", "n"),
    }


def total_area(polygons: DataFrame, unit: str = "ha") -> DataFrame:
    """Polygon count and strict area total (the scripts' control figure)."""
    div = float({"m2": 1, "ha": 10000}[unit])
    return polygons.agg(expr("count(1) AS n"), expr(
        f"CAST({strict_sum('area', type_of(polygons, 'area'))} AS DOUBLE) / {div!r}D AS total_area"))


def _stage_total(df: DataFrame, stage: str, unit: str) -> DataFrame:
    dtype = type_of(df, "area_t")
    return df.agg(
        expr(f"{lit(stage)} AS stage"),
        expr(f"{to_unit(strict_sum('area_t', dtype), unit)} AS total_area"),
        expr(f"{to_unit(total('area_t', dtype), unit)} AS total_area_known"),
        expr("count_if(area_t IS NULL) AS n_missing"),
    )


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """``df`` whose control totals (``area_t``) are taken while it is written,
    and where they can be read after that.  Put it where no shuffle follows
    (the task that writes a row counts it, once, retried or not)."""
    dtype, seen = type_of(df, "area_t"), Observation(stage)
    return df.observe(
        seen, expr(f"{strict_sum('area_t', dtype)} AS total"), expr(f"{total('area_t', dtype)} AS known"),
        expr("count_if(area_t IS NULL) AS n_missing")), seen


def observed_totals(spark, seen: Sequence[tuple[str, Observation]], unit: str = "m2") -> DataFrame:
    """``area_conservation`` of stages that were observed while they were
    written: no scan."""
    rows = [(stage, *(float(v) if v is not None else None for v in (o.get["total"], o.get["known"])), o.get["n_missing"]) for stage, o in seen]
    df = spark.createDataFrame(rows, "stage string, total double, known double, n_missing bigint")
    return df.selectExpr("stage", f"{to_unit('total', unit)} AS total_area", f"{to_unit('known', unit)} AS total_area_known", "n_missing")


def area_conservation(stages: Sequence[tuple[str, DataFrame]], unit: str = "ha") -> DataFrame:
    """Area total after each step: strict (missing if any piece is), the
    total of the known pieces, and the number of missing pieces.  Equal
    totals across a lookup mean its keys are unique."""
    out = None
    for name, df in stages:
        t = _stage_total(df, name, unit)
        out = t if out is None else out.unionByName(t)
    return out


def lookup_conservation(polygons: DataFrame, map_codes: DataFrame, categories: DataFrame, unit: str = "ha",
                        map_rows: int | None = None, cat_rows: int | None = None) -> DataFrame:
    """``area_conservation`` over component rows, EU rows, EU rows with
    names and with categories, in one scan: every stage is computed from one
    EU aggregate that also keeps the known-area sum and the number of
    missing component areas, so the four branches share its exchange."""
    from .ecosystems import components, with_categories, with_names  # noqa: PLC0415
    from ..functions.keys import bec_variant, ecosystem_label, ecosystem_unit, unit_key  # noqa: PLC0415

    d = components(polygons).selectExpr("strct", "area_t", f"{bec_variant()} AS bec_variant",
                                        f"{ecosystem_label()} AS ecosystem")
    dtype = type_of(d, "area_t")
    # the extra figures use the same aggregate functions as the strict sum
    # (count(area_t), count(1), sum(area_t)), so all branches share one
    # partial aggregate and one exchange
    # (written so that every branch lists them in the same order)
    eu = d.groupBy("bec_variant", "ecosystem", "strct").agg(
        expr("-count(area_t) + count(1) AS n_missing_parts"), expr(f"{total('area_t', dtype)} AS area_known"),
        expr(f"{strict_sum('area_t', dtype)} AS area_t"),
    ).selectExpr("*", f"{unit_key()} AS unit", f"{ecosystem_unit()} AS ecosystem_unit")
    known = total("area_known", type_of(eu, "area_known"))
    parts = eu.agg(
        expr(f"{lit('components')} AS stage"),
        # missing iff a unit total is missing (that keeps all three unit
        # columns in this branch, so its plan below the exchange is the same)
        expr(f"CASE WHEN count_if(area_t IS NULL) = 0 THEN {to_unit(known, unit)} END AS total_area"),
        expr(f"{to_unit(known, unit)} AS total_area_known"),
        expr("sum(n_missing_parts) AS n_missing"),
    )
    named = with_names(eu, map_codes, map_rows)
    stages = [("eu_rows", eu), ("eu_with_names", named),
              ("eu_with_categories", with_categories(named, categories, cat_rows))]
    out = parts
    for name, df in stages:
        out = out.unionByName(_stage_total(df, name, unit))
    return out


def rating_conservation(units: DataFrame, rated_units: DataFrame, unit: str = "m2") -> DataFrame:
    """Control totals of the rating job: after reshaping, over the key list and
    after the rating join.  All three derive from the same units."""
    keys = units.groupBy("eco").agg(expr(f"{strict_sum('area_t', type_of(units, 'area_t'))} AS area_t"))
    return area_conservation([("components", units), ("ecosystem_list", keys), ("rated", rated_units)], unit)


def duplicate_lookup_keys(rows: DataFrame, tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Keys used by ``rows`` that match more than one row of a lookup table;
    ``tables`` holds (check, table, key).  A missing key matches a missing key,
    as in the lookups.  One pass over ``rows``."""
    cells = ", ".join(f"named_struct('check', {lit(c)}, 'key', CAST({ident(k)} AS STRING))" for c, _, k in tables)
    used = rows.selectExpr(f"inline(array({cells}))").distinct().selectExpr("`check` AS __check", "key AS __key")
    dup = None
    for check, table, key in tables:
        d = table.groupBy(key).agg(expr("count(1) AS n")).filter("n > 1")
        d = d.selectExpr(f"{lit(check)} AS check", f"CAST({ident(key)} AS STRING) AS key", "n")
        dup = d if dup is None else dup.unionByName(d)
    return dup.join(used, expr("check = __check AND key <=> __key"), "left_semi")


def duplicate_components(rated: DataFrame, check: str, key: str = "fid", tags: Sequence[str] = NUMBER_TAGS) -> DataFrame:
    """Components with more than one row, reported as ``fid|component``:
    counted per polygon, so one row of three counts each is shuffled."""
    g = rated.groupBy(key).agg(*[expr(f"count_if(decile = {lit(t)}) AS n_{t}") for t in tags])
    cells = ", ".join(f"named_struct('key', concat(coalesce(CAST({ident(key)} AS STRING), {lit(NA_TEXT)}), '|', {lit(t)}), 'n', n_{t})" for t in tags)
    return g.filter(" OR ".join(f"n_{t} > 1" for t in tags)).selectExpr(f"{lit(check)} AS check", f"inline(array({cells}))").filter("n > 1")


def share_sums(polygons: DataFrame) -> DataFrame:
    """Polygons per total of shares (missing share as 0); all should be 10."""
    return polygons.groupBy(expr(f"{SHARE_SUM} AS share_sum")).agg(expr("count(1) AS n"))


def duplicate_rated(polygons: DataFrame, sheet: DataFrame, check: str, parts: Sequence[str] = RATING_KEY_PARTS,
                    rating_rows: int | None = None) -> DataFrame:
    """``duplicate_components`` of the rating job, looking only at polygons
    that can have any: on clean data no polygon is shuffled."""
    from .ratings import rate, rating_components, repeating_polygons  # noqa: PLC0415

    some = repeating_polygons(polygons, sheet, parts)
    if some is None:
        return polygons.sparkSession.createDataFrame([], "check string, key string, n bigint")
    return duplicate_components(rate(rating_components(some, parts), sheet, parts, rating_rows=rating_rows), check)
