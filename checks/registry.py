"""Queries by name, each from (session, data folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType

from checks import fixtures
from checks.operators import OPERATORS
from tradeweave.operators.joins import code_for_name
from tradeweave.plans.pipeline import DATASETS
from tradeweave.plans.study import Study
from tradeweave.sources.tables import country_names

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Fixed-point columns as doubles and doubles to six places, for comparison."""
    out = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            column = column.cast(DecimalType(38, 6)).cast("double")
        elif isinstance(f.dataType, DoubleType):
            column = F.round(column, 6)
        out.append(column.alias(f.name))
    return df.select(*out)


def _query(f: Callable[[Study], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(f(fixtures.study(spark, sf_dir)))


def country_to_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per country code, found from the name as each of them spells it."""
    spellings = F.array(*[F.lit(name) for name in fixtures.COUNTRY_SPELLINGS])
    place = (F.col("c_custkey") % len(fixtures.COUNTRY_SPELLINGS) + 1).cast("int")
    customers = fixtures.base(spark, sf_dir, "customer").select("c_custkey", F.element_at(spellings, place).alias("country"))
    codes, aliases = country_names(spark)
    return code_for_name(customers, "country", codes, aliases=aliases).select("c_custkey", "country", "iso3c")


def queries() -> dict[str, Query]:
    out = {name: _query(f) for name, f in {**OPERATORS, **DATASETS}.items()}
    out["country_to_code"] = country_to_code
    return out
