"""The incremental habitat job gives the batch result after each file."""

from ecotally.plans import ecosystems as eco
from ecotally.schema import CEM
from ecotally.session import scratch_path
from ecotally.sources.fixture import LOOKUP_ROWS, load_fixture
from ecotally.operators.project import canonicalise
from ecotally.streaming import latest_report, start_habitat_stream
from helpers import SF_SMALL


def _rows(df):
    return sorted((r["bhc20"] or "", round(r["total_area"] or -1.0, 6)) for r in df.collect())


def test_stream_resumes_from_its_checkpoint_and_matches_batch(spark):
    fx = load_fixture(spark, SF_SMALL)
    src, out, ckpt = (scratch_path(spark, n) for n in ("poly-src", "habitat-out", "habitat-ckpt"))
    kw = dict(output_dir=out, checkpoint_dir=ckpt, map_rows=LOOKUP_ROWS["map_codes"],
              cat_rows=LOOKUP_ROWS["habitat_categories"], available_now=True)
    # two deliveries: polygons split by key parity, written as parquet files
    fx.polygons.filter("FID % 2 = 0").write.parquet(f"{src}/batch=0")
    schema = spark.read.parquet(f"{src}/batch=0").schema
    q, _ = start_habitat_stream(spark, f"{src}/*", schema, CEM, fx.map_codes, fx.habitat_categories, **kw)
    q.awaitTermination(120)
    half = canonicalise(fx.polygons.filter("FID % 2 = 0"), CEM)
    assert _rows(latest_report(spark, out)) == _rows(
        eco.habitat_summary(half, fx.map_codes, fx.habitat_categories, map_rows=10, cat_rows=19))

    # a restarted query reads only the new delivery and adds it to its state
    fx.polygons.filter("FID % 2 = 1").write.parquet(f"{src}/batch=1")
    q2, _ = start_habitat_stream(spark, f"{src}/*", schema, CEM, fx.map_codes, fx.habitat_categories, **kw)
    q2.awaitTermination(120)
    assert q2.lastProgress["numInputRows"] == fx.polygons.filter("FID % 2 = 1").count()
    whole = canonicalise(fx.polygons, CEM)
    assert _rows(latest_report(spark, out)) == _rows(
        eco.habitat_summary(whole, fx.map_codes, fx.habitat_categories, map_rows=10, cat_rows=19))
