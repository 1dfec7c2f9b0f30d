"""Market concentration: how many members make up most of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.aggregates import strict_sum
from tradeweave.functions.domains import CONCENTRATION_PERCENT
from tradeweave.operators.windows import cumulative_share


def concentration(df: DataFrame, by: Sequence[str], member: str, value: str = "live_weight_t") -> DataFrame:
    """Weight of every member and its running percent within the group."""
    weights = df.groupBy(*by, member).agg(strict_sum(value).alias(value))
    return cumulative_share(weights, by, value, tie_break=member)


def n_below(df: DataFrame, by: Sequence[str], threshold: float = CONCENTRATION_PERCENT) -> DataFrame:
    """Members whose running percent stays strictly below the threshold.

    A group whose largest member reaches the threshold alone has no row.
    """
    return df.where(F.col("cumulative_percent") < threshold).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
