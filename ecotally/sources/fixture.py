"""Synthetic polygon fixture over the driver's ``orders`` table.

The same SQL text builds the tables on Spark (``spark.sql`` with the orders
DataFrame bound as ``{orders}``) and on DuckDB (the correctness oracle), so the
two engines start from identical rows.  ``polygons`` is a pure projection of
``orders`` (no shuffle, grows with the data); the four lookups are small
reference sheets whose row counts are fixed and therefore a proven bound for
broadcasting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The fixture definition (codes invented, zone / property /
# type / class / habitat-category names as used in the analysed scripts).
POLYGONS_SQL = """
SELECT o_orderkey AS FID, CASE WHEN o_orderkey = 103 THEN '87238' ELSE CAST(o_orderkey AS STRING) END AS CEM_ECP,
  CONCAT('P', CAST(o_custkey % 50 AS STRING)) AS ParcelID_t,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Dam' WHEN '2-HIGH' THEN 'Reservoir'
       WHEN '3-MEDIUM' THEN 'Transmission Line ROW' WHEN '4-NOT SPECIFIED' THEN 'Road' END AS PAZ,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'Footprint' END AS Dist_Type,
  CASE o_orderstatus WHEN 'F' THEN 'Marl Fen Property' WHEN 'O' THEN 'Other Property' END AS Location,
  CASE WHEN o_orderkey % 3 = 0 THEN 'PEL' ELSE 'KIP' END AS ECO_SEC,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ESSF' ELSE 'BWBS' END AS BGC_ZONE,
  CASE WHEN o_orderkey % 4 = 0 THEN 'mv' ELSE 'mw' END AS BGC_SUBZON,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 2 AS STRING) END AS BGC_VRT,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 10
       WHEN o_orderkey % 5 < 3 THEN 7 ELSE 5 END AS SDEC_1,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 4 THEN 5 ELSE 3 END AS SDEC_2,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL WHEN o_orderkey % 5 = 3 THEN 2 ELSE 0 END AS SDEC_3,
  CASE o_custkey % 6 WHEN 0 THEN '101' WHEN 1 THEN '102' WHEN 2 THEN '111' WHEN 5 THEN '112' END AS SITE_S1,
  CASE WHEN o_custkey % 2 = 0 THEN '102' END AS SITE_S2, CAST(NULL AS STRING) AS SITE_S3,
  CASE o_custkey % 6 WHEN 0 THEN 'AM' WHEN 1 THEN 'SW' WHEN 2 THEN 'SH'
       WHEN 3 THEN 'WA' WHEN 4 THEN 'CF' ELSE 'BT' END AS SITEMC_S1,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'SW' ELSE 'FM' END AS SITEMC_S2,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE 'OW' END AS SITEMC_S3,
  CASE WHEN o_custkey % 4 = 1 THEN 'k' END AS SITE_M1A, CAST(NULL AS STRING) AS SITE_M1B,
  CASE WHEN o_custkey % 4 = 2 THEN 'w' END AS SITE_M2A, CAST(NULL AS STRING) AS SITE_M2B,
  CAST(NULL AS STRING) AS SITE_M3A, CAST(NULL AS STRING) AS SITE_M3B,
  CASE WHEN o_custkey % 8 = 0 THEN NULL WHEN o_custkey % 41 = 0 THEN '3a'
       ELSE CAST(o_custkey % 8 AS STRING) END AS STRCT_S1,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1 + o_custkey % 7 AS STRING) END AS STRCT_S2,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE '1' END AS STRCT_S3,
  CASE o_custkey % 9 WHEN 0 THEN 'i' WHEN 1 THEN 's' END AS STRCT_M1,
  CAST(NULL AS STRING) AS STRCT_M2,
  CASE WHEN o_custkey % 13 = 0 THEN '3' END AS STRCT_M3,
  CASE WHEN o_custkey % 5 = 0 THEN 'as' END AS SERAL_1,
  CASE WHEN o_custkey % 7 = 0 THEN 'ap' END AS SERAL_2,
  CAST(NULL AS STRING) AS SERAL_3,
  CAST(o_totalprice AS DECIMAL(15,2)) AS AREA
FROM {orders}"""

MAP_CODES_SQL = """
SELECT * FROM (VALUES
  (1,'BWBSmw1','AM','101','Aspen mesic','Upland Forest'), (2,'BWBSmw1','AM:as','101','Aspen mesic seral','Upland Forest'),
  (3,'BWBSmw1','SW','102','Spruce moist','Upland Forest'), (4,'BWBSmw2','SW','102','Spruce moist','Upland Forest'),
  (5,'BWBSmw1','SH','111','Shrub swale','Riparian'),       (6,'BWBSmw2','WA',NULL,'Water body','Water'),
  (7,'BWBSmw1','CF',NULL,'Cultivated field','Anthropogenic Areas'), (8,'ESSFmv1','FM','103','Fir mesic','Upland Forest'),
  (9,'BWBSmw2','OW',NULL,'Open water','Water'),            (10,'BWBSmw2','BT','112','Bog tamarack','Wetland')
 ) AS t(Sort, bec_variant, map_code, site_series, site_series_name, Type)"""

HABITAT_CATEGORIES_SQL = """
SELECT * FROM (VALUES ('AM5','DYF'),('AM6','DMF'),('AM:as3','DSH'),('SW4','CYF'),('SW5','CYF'),('SW6','CMF'),
  ('SW3','CSH'),('SH2','WGR'),('SH3','WSH'),('WA','WAT'),('CF1','CUL'),('FM7','RMF'),('FM4','RYF'),('OW1','WAT'),
  ('BT4','FBT'),('BT5','FBT'),('BT1','ZZZ'),('SW2','DSG'),('SW2','DSS')) AS t(ecosystem_unit, BHC20)"""

RATINGS_SQL = """
SELECT * FROM (VALUES
  ('PEL','BWBS','mw','1','101','AM',NULL,NULL,'6',NULL,NULL,'H'), ('KIP','BWBS','mw','2','102','SW','k',NULL,'1','s',NULL,'M'),
  ('KIP','BWBS','mw','2','102','SW',NULL,NULL,'5',NULL,NULL,'L'), ('KIP','ESSF','mv','1',NULL,'FM',NULL,NULL,'4',NULL,NULL,'N'),
  ('PEL','BWBS','mw','2',NULL,'OW',NULL,NULL,'1',NULL,NULL,'N'), ('KIP','BWBS','mw',NULL,'102','SW',NULL,NULL,'1',NULL,NULL,'L'),
  ('KIP','BWBS','mw','2','102','SW','k',NULL,'1','',NULL,'H'), ('KIP','BWBS','mw','2','102','SW','k',NULL,'5','','as','M')
 ) AS t(ECO_SEC,BGC_ZONE,BGC_SUBZON,BGC_VRT,SITE_S,SITEMC_S,SITE_MA,SITE_MB,STRCT_S,STRCT_M,SERAL,BSEOW_LI)"""

# the revised sheet: no site series, one rating changed, one dropped, one new
RATINGS_REVISED_SQL = """
SELECT * FROM (VALUES
  ('PEL','BWBS','mw','1','AM',NULL,NULL,'6',NULL,NULL,'M'), ('KIP','BWBS','mw','2','SW','k',NULL,'1','s',NULL,'M'),
  ('KIP','ESSF','mv','1','FM',NULL,NULL,'4',NULL,NULL,'N'), ('PEL','BWBS','mw','2','OW',NULL,NULL,'1',NULL,NULL,'L'),
  ('KIP','BWBS','mw','2','FM',NULL,NULL,'4',NULL,NULL,'H')
 ) AS t(ECO_SEC,BGC_ZONE,BGC_SUBZON,BGC_VRT,SITEMC_S,SITE_MA,SITE_MB,STRCT_S,STRCT_M,SERAL,BSEOW_LI)"""

# the polygons as a terrestrial-map workbook spells them, areas in hectares; the terrestrial map sees bog in every third one
TEM_SQL = """
SELECT CEM_ECP AS ECP_TAG, Location, Dist_Type, ParcelID_t, ECO_SEC AS Eco_Sec, BGC_ZONE AS Bgc_Zone,
  BGC_SUBZON AS Bgc_Subzon, BGC_VRT AS Bgc_Vrt, SDEC_1 AS Sdec_1, SDEC_2 AS Sdec_2, SDEC_3 AS Sdec_3,
  SITE_S1 AS Site_S1, SITE_S2 AS Site_S2, SITE_S3 AS Site_S3, CASE WHEN FID % 3 = 0 THEN 'BT' ELSE SITEMC_S1 END AS SiteMC_S1, SITEMC_S2 AS SiteMC_S2,
  SITEMC_S3 AS SiteMC_S3, STRCT_S1 AS Strct_S1, STRCT_S2 AS Strct_S2, STRCT_S3 AS Strct_S3, SERAL_1 AS Seral_1,
  SERAL_2 AS Seral_2, SERAL_3 AS Seral_3, CAST(AREA * 0.0001 AS DECIMAL(19,6)) AS Area_ha
FROM {polygons}"""

CROSSWALK_SQL = """
SELECT * FROM (VALUES ('AM:as','AM'),('SW','SW'),('SH','WS'),('FM:ap','FM'),('BT','BT')) AS t(eco, SITEMC_replace)"""

# Row counts of the fixed lookup sheets: the proven size bound used when
# deciding to broadcast them.
LOOKUP_ROWS = {"map_codes": 10, "habitat_categories": 19, "ratings": 8, "ratings_revised": 5, "crosswalk": 5}


def duckdb_ctes() -> str:
    """The fixture as a DuckDB ``WITH`` prefix over the pre-registered views."""
    parts = [
        ("polygons", POLYGONS_SQL.replace("{orders}", "orders")),
        ("map_codes", MAP_CODES_SQL),
        ("habitat_categories", HABITAT_CATEGORIES_SQL),
        ("ratings", RATINGS_SQL),
        ("ratings_revised", RATINGS_REVISED_SQL),
        ("crosswalk", CROSSWALK_SQL),
    ]
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n"


@dataclass(frozen=True)
class Fixture:
    polygons: DataFrame  # raw spelling, as a source file would arrive
    map_codes: DataFrame
    habitat_categories: DataFrame
    ratings: DataFrame
    ratings_revised: DataFrame
    crosswalk: DataFrame
    polygons_tem: DataFrame  # terrestrial-map spelling, hectares


def load_fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    polygons = spark.sql(POLYGONS_SQL, orders=orders)
    return Fixture(
        polygons=polygons,
        map_codes=spark.sql(MAP_CODES_SQL),
        habitat_categories=spark.sql(HABITAT_CATEGORIES_SQL),
        ratings=spark.sql(RATINGS_SQL),
        ratings_revised=spark.sql(RATINGS_REVISED_SQL),
        crosswalk=spark.sql(CROSSWALK_SQL),
        polygons_tem=spark.sql(TEM_SQL, polygons=polygons),
    )
