"""Declared schemas of the input tables; nothing is inferred."""

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Tonnes. A fixed-point type keeps sums independent of row order.
WEIGHT = DecimalType(18, 2)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


SNET = _struct(
    record_id=LongType(),
    year=IntegerType(),
    hs_version=StringType(),
    hs6=IntegerType(),
    exporter_iso3c=StringType(),
    importer_iso3c=StringType(),
    habitat=StringType(),
    method=StringType(),
    dom_source=StringType(),
    live_weight_t=WEIGHT,
    product_weight_t=WEIGHT,
)
PRODUCTION = _struct(
    record_id=LongType(),
    iso3c=StringType(),
    year=IntegerType(),
    sciname=StringType(),
    method=StringType(),
    habitat=StringType(),
    live_weight_t=WEIGHT,
)
COUNTRIES = _struct(record_id=IntegerType(), iso3c=StringType(), owid_region=StringType())
CODE_MAX_RESOLVED_TAXA = _struct(record_id=LongType(), hs6=IntegerType())
SCINAME = _struct(record_id=LongType(), sciname=StringType(), common_name=StringType())
POPULATION = _struct(record_id=LongType(), iso3c=StringType(), year=IntegerType(), pop=LongType())
CONSUMPTION = _struct(
    record_id=LongType(),
    year=IntegerType(),
    hs_version=StringType(),
    consumer_iso3c=StringType(),
    source_country_iso3c=StringType(),
    sciname_hs_modified=StringType(),
    habitat=StringType(),
    method=StringType(),
    consumption_source=StringType(),
    consumption_live_t=WEIGHT,
)
CENTROIDS = _struct(
    iso3=StringType(), adm1_code=StringType(), centroid_lon=DoubleType(), centroid_lat=DoubleType()
)

TABLES = {
    "snet": SNET,
    "production": PRODUCTION,
    "countries": COUNTRIES,
    "code_max_resolved_taxa": CODE_MAX_RESOLVED_TAXA,
    "sciname": SCINAME,
    "population": POPULATION,
    "consumption": CONSUMPTION,
    "centroids": CENTROIDS,
}

# Tables laid out by product-code version and year, so that reading one version
# per year range opens only the matching folders.
PARTITIONED = {"snet": ("hs_version", "year"), "consumption": ("hs_version", "year")}

# Tables large enough to be read from a database in parallel.
BY_YEAR = ("snet", "production", "consumption")
