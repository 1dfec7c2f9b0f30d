"""Ranks, shares and running totals inside groups.

Meant for aggregated tables: a group holds countries, species or categories, not
detail rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tradeweave.functions.aggregates import strict_sum
from tradeweave.functions.columns import ColumnLike, as_col, percent, ratio


def _group(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by)


def cumulative_share(
    df: DataFrame, by: Sequence[str], value: str, tie_break: str, name: str = "cumulative_percent"
) -> DataFrame:
    """Running percent of the group total, largest first, row by row.

    Equal values are taken in the order of ``tie_break``. A group with a missing
    value has no percents. The total and the running sum share one shuffle and one
    sort.
    """
    running = _group(by).orderBy(F.col(value).desc(), F.col(tie_break)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    complete = F.count(F.lit(1)).over(_group(by)) == F.count(value).over(_group(by))
    return df.withColumn(name, F.when(complete, percent(F.sum(value).over(running), F.sum(value).over(_group(by)))))


def group_total(df: DataFrame, by: Sequence[str], value: str, name: str, skip_missing: bool = False) -> DataFrame:
    """Group total attached to every row; missing if any input is, unless skipped."""
    if skip_missing:
        return df.withColumn(name, F.coalesce(F.sum(value).over(_group(by)), F.lit(0)))
    complete = F.count(F.lit(1)).over(_group(by)) == F.count(value).over(_group(by))
    return df.withColumn(name, F.when(complete, F.sum(value).over(_group(by))))


def share_of_group(
    df: DataFrame, by: Sequence[str], value: str, name: str, total: str = "group_total", as_percent: bool = True
) -> DataFrame:
    """Part of the group total, in percent or as a fraction; keeps the total."""
    df = group_total(df, by, value, total)
    return df.withColumn(name, percent(value, total) if as_percent else ratio(value, total))


def share_of_all(df: DataFrame, value: str, name: str, total: str) -> DataFrame:
    """Percent of the whole table. The total is a scalar subquery: nothing is moved
    to one partition and nothing is joined."""
    whole = df.agg(strict_sum(value).alias(total)).scalar()
    return df.withColumn(total, whole).withColumn(name, percent(value, total))


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Ascending rank; equal values share the mean of their positions.

    A missing value has no rank and does not shift the others.
    """
    rank = F.rank().over(_group(by).orderBy(F.col(value).asc_nulls_last())) + (
        F.count(F.lit(1)).over(_group([*by, value])) - 1
    ) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), rank)


def top_k(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """The k largest rows of each group, or of the table when ``by`` is empty.

    Ties at the k-th place are all kept. Every task drops rows beyond its own k
    before the shuffle.
    """
    place = F.rank().over(_group(by).orderBy(F.col(value).desc_nulls_last()))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def order_by_measure(by: Sequence[str], *order: ColumnLike) -> Column:
    """Position of a category when categories are ordered by a measure."""
    return F.dense_rank().over(_group(by).orderBy(*[as_col(c) for c in order]))


def rows_at_max(df: DataFrame, value: str) -> DataFrame:
    """Every row that holds the largest value of the column.

    Ranked rather than compared with a maximum worked out on its own, which for
    sums of doubles might differ in the last digit.
    """
    return top_k(df.where(F.col(value).isNotNull()), [], value, 1)


def rows_at_min(df: DataFrame, value: str) -> DataFrame:
    place = F.rank().over(_group([]).orderBy(F.col(value)))
    ranked = df.where(F.col(value).isNotNull()).withColumn("_place", place)
    return ranked.where(F.col("_place") <= 1).drop("_place")
