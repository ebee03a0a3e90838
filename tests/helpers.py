"""Constants and small hand-made tables in the canonical polygon layout."""

from pyspark.sql import types as T

from ecotally.schema import COMPONENT_FIELDS, wide

SF_SMALL = "/root/testdata/sf0.001"

POLYGON_TYPES = {
    "fid": T.LongType(), "cem_ecp": T.StringType(), "parcel_id": T.StringType(), "paz": T.StringType(),
    "dist_type": T.StringType(), "location": T.StringType(), "eco_sec": T.StringType(),
    "bgc_zone": T.StringType(), "bgc_subzon": T.StringType(), "bgc_vrt": T.StringType(),
    "area": T.DoubleType(),
}


def polygon_schema():
    fields = [T.StructField(k, v) for k, v in POLYGON_TYPES.items()]
    for n in (1, 2, 3):
        for f in COMPONENT_FIELDS:
            fields.append(T.StructField(wide(f, n), T.IntegerType() if f == "sdec" else T.StringType()))
    return T.StructType(fields)


def polygons(spark, rows):
    """rows: dicts with any canonical columns; the rest are missing."""
    schema = polygon_schema()
    defaults = {"fid": 1, "cem_ecp": "1", "eco_sec": "KIP", "bgc_zone": "BWBS", "bgc_subzon": "mw", "bgc_vrt": "1"}
    data = []
    for i, r in enumerate(rows):
        row = {**defaults, "fid": i + 1, "cem_ecp": str(i + 1), **r}
        data.append(tuple(row.get(f.name) for f in schema.fields))
    return spark.createDataFrame(data, schema)


def sheet(spark, rows, columns):
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def map_codes(spark, rows):
    """rows: (bec_variant, map_code, site_series_name, type)"""
    schema = T.StructType([T.StructField("Sort", T.IntegerType())] + [
        T.StructField(c, T.StringType()) for c in ("bec_variant", "map_code", "site_series", "site_series_name", "Type")
    ])
    return spark.createDataFrame([(i + 1, b, m, None, n, t) for i, (b, m, n, t) in enumerate(rows)], schema)


def categories(spark, rows):
    return sheet(spark, rows, ["ecosystem_unit", "BHC20"])
