"""Which product-code version counts in which years, as a table.

The published ranges are a predicate (``functions.columns.in_regime``). As a table,
other choices can be kept beside them under names of their own. Joined to facts laid
out by version and year, the table's rows become a filter on folders while the query
runs, so that only the folders of the chosen versions are opened.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.functions.domains import REGIMES

DEFAULT_REGIME = "authoritative"
SCHEMA = "regime string, hs_version string, first_year int, last_year int"
# A range without a first or last year is taken to cover these.
EARLIEST, LATEST = 1900, 2100


def regime_table(
    spark: SparkSession, ranges: Iterable[tuple[str, int | None, int | None]] = REGIMES, name: str = DEFAULT_REGIME
) -> DataFrame:
    """Version ranges under a name; union several to keep them in one table."""
    return spark.createDataFrame([(name, *r) for r in ranges], SCHEMA)


def regime_years(regimes: DataFrame, name: str = DEFAULT_REGIME, open_start: bool = False) -> DataFrame:
    """(hs_version, year) of a named regime, each once; ranges may overlap.

    With ``open_start`` the earliest range has no first year.
    """
    chosen = regimes.where(F.col("regime") == name)
    first = F.coalesce("first_year", F.lit(EARLIEST))
    if open_start:
        start = chosen.agg(F.min("first_year")).scalar()
        first = F.when(first == start, F.lit(EARLIEST)).otherwise(first)
    years = F.sequence(first, F.greatest(first, F.coalesce("last_year", F.lit(LATEST))))
    return (
        chosen.where(first <= F.coalesce("last_year", F.lit(LATEST)))
        .select("hs_version", F.explode(years).alias("year"))
        .distinct()
    )


def in_regime_table(
    df: DataFrame, regimes: DataFrame, name: str = DEFAULT_REGIME, open_start: bool = False, mark: str = ""
) -> DataFrame:
    """Rows whose version counts in their year; with ``mark`` all rows, told by that column."""
    years = regime_years(regimes, name, open_start)
    if mark:
        flag = years.select(F.col("hs_version").alias("_v"), F.col("year").alias("_y"), F.lit(True).alias(mark))
        return df.join(flag, (df["hs_version"] == F.col("_v")) & (df["year"] == F.col("_y")), "left").drop("_v", "_y")
    return df.join(years, ["hs_version", "year"], "left_semi").select(*df.columns)
