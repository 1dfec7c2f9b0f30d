"""Stacking, widening and lengthening tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns matched by name, absent ones missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def stack_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """All rows of all tables, each marked with the name of its table."""
    return stack(*[df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def computed_once(df: DataFrame) -> DataFrame:
    """An aggregated table of which all uses in one plan need the same.

    Spark computes equal branches of a plan once, but first drops what a branch does
    not use and moves its filters down, which makes them unequal. A test that reads all
    columns, is always true, and cannot be moved keeps them equal above the shuffle.
    """
    return df.where(F.rand(0) + F.pmod(F.xxhash64(*df.columns), F.lit(2)) >= 0)


def with_total_rows(df: DataFrame, category: str, total: str = "total") -> DataFrame:
    """Every row once under its category and once under ``total``.

    Grouping the result gives detail and subtotal from one scan. Apply it after a
    first aggregation, when doubling the rows costs nothing.
    """
    return df.withColumn(category, F.explode(F.array(F.col(category), F.lit(total))))


def wide(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: Sequence,
    cell: Column,
    fill: float | None = None,
    prefix: str = "",
) -> DataFrame:
    """One column per listed value of ``names``; ``fill`` replaces absent cells.

    The values are given, so no extra job looks for them.
    """
    out = df.groupBy(*ids).pivot(names, list(values)).agg(cell)
    if prefix:
        out = out.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})
    return out if fill is None else out.na.fill(fill, [f"{prefix}{v}" for v in values])


def long(df: DataFrame, columns: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """One row per listed column, the other columns repeated."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), names_to, values_to)


def long_split(df: DataFrame, columns: Sequence[str], into: Sequence[str], values_to: str, sep: str) -> DataFrame:
    """As ``long``, with the column name split into several columns."""
    parts = F.split("_name", sep)
    out = long(df, columns, "_name", values_to)
    return out.withColumns({name: parts[i] for i, name in enumerate(into)}).drop("_name")


def flow_links(df: DataFrame, stages: Sequence[str], value: str) -> DataFrame:
    """Rows of a flow diagram: each stage's node with the node it leads to.

    The last stage leads nowhere, so its next node is missing.
    """
    none = F.lit(None).cast("string")
    links = [
        F.struct(
            F.lit(stage).alias("x"),
            F.col(stage).alias("node"),
            (F.lit(following) if following else none).alias("next_x"),
            (F.col(following) if following else none).alias("next_node"),
        )
        for stage, following in zip(stages, [*stages[1:], None])
    ]
    return df.select(F.col(value).alias("value"), F.explode(F.array(*links)).alias("link")).select("link.*", "value")


def metric_table(row: DataFrame) -> DataFrame:
    """A one-row table of named numbers as (metric, value) rows."""
    doubles = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return doubles.unpivot([], doubles.columns, "metric", "value")
