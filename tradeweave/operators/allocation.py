"""Capping of per-capita supply and proportional reallocation.

Where a country's yearly supply exceeds the cap, the whole is set to the cap and
every part keeps its share. The correction is linear in the parts, so it may be
applied to detail rows or to sums over them with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from tradeweave.functions.domains import MAX_KG_PER_CAPITA
from tradeweave.operators.joins import lookup

KEYS = ("consumer_iso3c", "year")

# Decimal weights stay exact: the factor is a fixed-point number, so corrected
# sums do not depend on row order or on the grain they are computed at.
_CORRECTED = DecimalType(16, 3)
_FACTOR = DecimalType(16, 15)


def exceeds_cap(total_t: Column, people: Column, cap_kg: int = MAX_KG_PER_CAPITA) -> Column:
    """More kilograms than people times the cap (no division, so no zero case)."""
    return total_t * F.lit(1000) > people * F.lit(cap_kg)


def corrected_total(people: Column, cap_kg: int = MAX_KG_PER_CAPITA) -> Column:
    """Total at the cap, in tonnes."""
    return (people * F.lit(cap_kg)).cast(DecimalType(20, 0)) / F.lit(1000)


def complete_sum(value: str, window: WindowSpec | None = None) -> Column:
    """Sum of partial sums, missing if any of them skipped a missing weight."""
    total, missing = F.sum(value), F.sum("n_missing")
    if window is not None:
        total, missing = total.over(window), missing.over(window)
    return F.when(missing == 0, total)


def cap_factor(total_t: Column, people: Column, weight: DataType, cap_kg: int = MAX_KG_PER_CAPITA) -> Column:
    """What to multiply each part with: below one for outliers, missing otherwise."""
    over = exceeds_cap(total_t, people, cap_kg)
    if isinstance(weight, DecimalType):
        factor = (corrected_total(people, cap_kg).cast(_CORRECTED) / total_t.cast(DecimalType(18, weight.scale))).cast(_FACTOR)
    else:
        factor = corrected_total(people, cap_kg).cast("double") / total_t
    return F.when(over, factor)


def scaled(part: Column, factor: Column, weight: DataType) -> Column:
    """A part after the correction; unchanged where there is no factor."""
    if isinstance(weight, DecimalType):
        return part.cast(DecimalType(20, weight.scale)) * F.coalesce(factor, F.lit(1).cast(_FACTOR))
    return part * F.coalesce(factor, F.lit(1.0))


def outliers(parts: DataFrame, population: DataFrame, cap_kg: int = MAX_KG_PER_CAPITA) -> DataFrame:
    """Consumer-years over the cap, with their corrected total and factor.

    ``parts`` holds ``consumption_live_t`` and ``n_missing``, how many missing
    weights each row stands for; a total with one is unknown. The result has at
    most one row per population row: without a population there is no per-capita
    figure and no correction.
    """
    weight = parts.schema["consumption_live_t"].dataType
    totals = parts.groupBy(*KEYS).agg(complete_sum("consumption_live_t").alias("total_t"))
    people = {"consumer_iso3c": "iso3c", "year": "year"}
    totals = lookup(totals, population, people, {"pop": "pop"}, unique="population")
    total, people = F.col("total_t"), F.col("pop")
    return totals.where(exceeds_cap(total, people, cap_kg)).select(
        *KEYS,
        corrected_total(people, cap_kg).alias("corrected_consumption_t"),
        cap_factor(total, people, weight, cap_kg).alias("factor"),
    )
