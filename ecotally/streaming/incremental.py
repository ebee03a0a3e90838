"""The habitat-category job (D6) over a folder that receives polygon files.

The source scripts are batch-only; this is the same job run incrementally
for map updates delivered as files.  The stream keeps one state row per
ecosystem unit (the strict-sum parts: number of rows, number of known areas,
area total), so state is bounded by the distinct codes, not the polygons.
Each micro-batch sees the complete unit table, applies the (small,
broadcast) lookups and writes the report as a new version; ``latest_report``
reads the last complete one.  Checkpoint and report live in
the shared checkpoint folder, so a restarted query resumes from its state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.keys import bec_variant, ecosystem_label, ecosystem_unit, unit_key
from ..functions.nulls import expr, total, type_of
from ..operators.project import canonicalise
from ..plans import ecosystems as eco
from ..schema import SourceSpelling
from ..session import scratch_path


def unit_state(polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Streaming aggregate per ecosystem unit: counts and sum kept apart so
    the strict sum can be finished after any number of batches."""
    d = eco.components(polygons, ids=by).selectExpr(
        *by, "strct", "area_t", f"{bec_variant()} AS bec_variant", f"{ecosystem_label()} AS ecosystem")
    return d.groupBy(*by, "bec_variant", "ecosystem", "strct").agg(
        expr("count(1) AS n"), expr("count(area_t) AS n_known"), expr(f"{total('area_t', type_of(d, 'area_t'))} AS area_sum"))


def finish_units(state: DataFrame) -> DataFrame:
    """Unit rows as ``eu_units`` gives them, from the streamed state."""
    return state.selectExpr(
        "*", "CASE WHEN n_known = n THEN area_sum END AS area_t",
        f"{unit_key()} AS unit", f"{ecosystem_unit()} AS ecosystem_unit",
    ).drop("n_known", "area_sum")


def latest_report(spark: SparkSession, output_dir: str) -> DataFrame:
    """The report of the last micro-batch that was written in full."""
    versions = spark.read.parquet(output_dir)
    last = versions.agg(expr("max(version)")).first()[0]
    return versions.filter(f"version = {last}").drop("version")


def start_habitat_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    spelling: SourceSpelling,
    map_codes: DataFrame,
    categories: DataFrame,
    output_dir: str | None = None,
    checkpoint_dir: str | None = None,
    map_rows: int | None = None,
    cat_rows: int | None = None,
    available_now: bool = False,
):
    """Start the incremental D6 job; returns (StreamingQuery, output_dir).

    ``schema`` is the declared schema of the polygon files (parquet).
    """
    output_dir = output_dir or scratch_path(spark, "habitat-report")
    checkpoint_dir = checkpoint_dir or scratch_path(spark, "habitat-stream-ckpt")
    raw = spark.readStream.schema(schema).parquet(source_dir)
    state = unit_state(canonicalise(raw, spelling))

    def write_report(batch: DataFrame, batch_id: int) -> None:
        units = finish_units(batch)
        cat = eco.with_categories(eco.with_names(units, map_codes, map_rows), categories, cat_rows)
        report = eco.bhc_summary(cat)
        report.write.mode("overwrite").parquet(f"{output_dir}/version={batch_id}")

    writer = (
        state.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint_dir)
        .foreachBatch(write_report)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(), output_dir
