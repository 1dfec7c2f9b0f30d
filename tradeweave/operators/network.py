"""Degree of countries in the directed trade network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE, TARGET = "exporter_iso3c", "importer_iso3c"


def edges(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct directed edges within each group. Duplicates go before the shuffle."""
    return df.select(*by, SOURCE, TARGET).distinct()


def edge_sets(df: DataFrame, by: Sequence[str], category: str, levels: Sequence[str]) -> DataFrame:
    """One row per edge and group, with all categories the edge occurs in.

    ``bits`` has a bit per level and one for a missing category; ``others`` lists
    categories outside the levels, none in the usual case. Both combine before the
    shuffle, which carries an edge once however many categories it has.
    """
    c = F.col(category)
    bit = F.when(c.isNull(), F.lit(1 << len(levels)))
    for i, level in enumerate(levels):
        bit = bit.when(c == level, F.lit(1 << i))
    outside = F.when(c.isNotNull() & ~c.isin(*levels), c)
    return df.groupBy(*by, SOURCE, TARGET).agg(
        F.bit_or(bit.otherwise(F.lit(0))).alias("bits"), F.collect_set(outside).alias("others")
    )


def categories_of(levels: Sequence[str], bits: Column, others: Column) -> Column:
    """The categories that a row of ``edge_sets`` stands for; a missing one is an element."""
    known = [F.when(bits.bitwiseAND(1 << i) != 0, F.array(F.lit(level))).otherwise(F.array().cast("array<string>")) for i, level in enumerate(levels)]
    missing = F.when(bits.bitwiseAND(1 << len(levels)) != 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.concat(*known, missing, others)


def degrees_from_sets(sets: DataFrame, by: Sequence[str], category: str, levels: Sequence[str], which: str = "both") -> DataFrame:
    """Degrees from ``edge_sets``: over all categories, within each, or both.

    An edge is already one row, so nothing is made distinct again. With ``both`` the
    column ``level`` tells rows over "all" categories from those "within" one.
    """
    whole = F.array(F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias(category)))
    within = F.transform(
        categories_of(levels, F.col("bits"), F.col("others")),
        lambda c: F.struct(F.lit("within").alias("level"), c.alias(category)),
    )
    chosen = {"all": whole, "within": within, "both": F.concat(whole, within)}[which]
    rows = sets.select(*by, SOURCE, TARGET, F.explode(chosen).alias("_in")).select(*by, SOURCE, TARGET, "_in.*")
    keys = {"all": [*by], "within": [*by, category], "both": [*by, "level", category]}[which]
    return _both_ends(rows, keys)


def _both_ends(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    ends = F.array(
        F.struct(F.col(SOURCE).alias("iso3c"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col(TARGET).alias("iso3c"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )
    return (
        edges.select(*by, F.explode(ends).alias("end"))
        .groupBy(*by, F.col("end.iso3c").alias("iso3c"))
        .agg(
            F.nullif(F.sum("end.out"), F.lit(0)).alias("all_out_degree"),
            F.nullif(F.sum("end.in"), F.lit(0)).alias("all_in_degree"),
        )
    )


def degrees(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of partners sold to and bought from, per group and country.

    Each edge counts once for either end, so one pass gives both degrees without
    joining two counts. A country that only buys or only sells has a missing
    degree on the other side.
    """
    return _both_ends(edges(df, by), by)


def degree_of(df: DataFrame, by: Sequence[str], end: str, name: str) -> DataFrame:
    """One-sided degree: partners per group and country at the given end."""
    return edges(df, by).groupBy(*by, F.col(end).alias("iso3c")).agg(F.count(F.lit(1)).alias(name))
