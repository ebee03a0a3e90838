"""ecotally — ecosystem-map area accounting on Apache Spark.

Polygon tables whose polygons hold up to three ecosystem components (shares
in tenths) are turned into component rows, apportioned, looked up against
name / habitat-category / rating sheets and summed into area reports.  Every
job is a DataFrame / Spark SQL plan (no UDFs).

Main entry points::

    from ecotally import canonicalise, CEM, TEM, components, eu_summary, habitat_summary
    polygons = canonicalise(spark.read.parquet(path), CEM)
    report = habitat_summary(polygons, map_codes, categories)
"""

from .operators.aggregate import crosstab, frequencies, group_area
from .operators.lookup import crosswalk, lookup
from .operators.project import canonicalise, cols_between, move_first
from .operators.reshape import to_long, to_wide
from .plans.ecosystems import (
    bhc_summary, components, crosswalked_habitat_summary, eu_after, eu_report, eu_summary, eu_units,
    habitat_summary, mc_report, property_polygons, with_categories, with_names,
)
from .plans.parcels import parcel_area, parcel_habitat, parcel_report, parcel_units
from .plans.ratings import (
    ecosystem_list, first_component_rating, rate, rated_rows, rating_area, rating_components, rating_wide, unmatched,
)
from .schema import CEM, CEM_SHAPE_AREA, SOURCES, TEM

__all__ = [
    "CEM", "CEM_SHAPE_AREA", "SOURCES", "TEM",
    "canonicalise", "cols_between", "move_first", "to_long", "to_wide", "lookup", "crosswalk",
    "group_area", "frequencies", "crosstab",
    "components", "eu_units", "eu_summary", "eu_report", "with_names", "with_categories", "bhc_summary",
    "habitat_summary", "mc_report", "eu_after", "property_polygons", "crosswalked_habitat_summary",
    "parcel_units", "parcel_area", "parcel_habitat", "parcel_report",
    "rating_components", "rate", "rated_rows", "rating_area", "rating_wide", "unmatched", "ecosystem_list",
    "first_component_rating",
]
