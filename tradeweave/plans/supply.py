"""Datasets about apparent consumption and supply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions import domains as d
from tradeweave.functions.aggregates import narm_sum, strict_sum, sum_where
from tradeweave.functions.columns import (
    consumption_source_label,
    habitat_method,
    habitat_method_text,
    is_known_region,
    kg_per_capita,
    millions,
    percent,
)
from tradeweave.operators import allocation as cap
from tradeweave.operators.joins import lookup, without_keys
from tradeweave.operators.reshape import long, stack, wide
from tradeweave.operators.windows import group_total, order_by_measure, share_of_all, share_of_group, top_k
from tradeweave.plans.study import Study, combine_parts, consumption_rows, in_slice

TONNES = "consumption_live_t"


# -- per-capita cap ------------------------------------------------------------


def _outliers(s: Study, year: int | None = None) -> DataFrame:
    """Consumer-years over the cap.

    Joined without a hint: by the size measured while running, Spark sends the list
    to the rows or splits a hot consumer-year.
    """
    parts = s.consumption() if year is None else s.consumption().where(F.col("year") == year)
    return cap.outliers(parts, s.tables.population, s.max_kg_per_capita)


def consumption_outliers(s: Study) -> DataFrame:
    return _outliers(s).select(*cap.KEYS, "corrected_consumption_t")


def consumption_scaled(s: Study) -> DataFrame:
    """Detail rows of the outliers, each cut in proportion."""
    rows = consumption_rows(s)
    weight = rows.schema[TONNES].dataType
    return (
        rows.join(_outliers(s), list(cap.KEYS))
        .withColumn(TONNES, cap.scaled(F.col(TONNES), F.col("factor"), weight))
        .drop("factor", "corrected_consumption_t")
        .withColumn("consumer_year", F.concat_ws("_", "consumer_iso3c", "year"))
    )


def _with_places(s: Study, df: DataFrame) -> DataFrame:
    """Regions of consumer and source; rows without a regular region are dropped."""
    places = s.tables.countries
    df = lookup(df, places, {"consumer_iso3c": "iso3c"}, {"consumer_region": "owid_region"}, unique="countries")
    df = lookup(df, places, {"source_country_iso3c": "iso3c"}, {"source_region": "owid_region"}, unique="countries")
    return df.where(is_known_region("consumer_region") & is_known_region("source_region"))


def _with_common_names(s: Study, df: DataFrame) -> DataFrame:
    """Common names; a species with several names takes one row for each."""
    return lookup(
        df, s.tables.sciname, {"sciname_hs_modified": "sciname"}, {"common_name": "common_name"},
        null_safe=["sciname_hs_modified"],
    )


def consumption_percap_adjusted(s: Study) -> DataFrame:
    """All consumption rows after the cap, with regions and common names.

    The list of outliers is joined to the rows once they are known.
    """
    rows = consumption_rows(s)
    weight = rows.schema[TONNES].dataType
    adjusted = (
        rows.join(_outliers(s).drop("corrected_consumption_t"), list(cap.KEYS), "left")
        .withColumn(TONNES, cap.scaled(F.col(TONNES), F.col("factor"), weight))
        .drop("factor")
        .withColumn("consumer_year", F.concat_ws("_", "consumer_iso3c", "year"))
    )
    return _with_common_names(s, _with_places(s, adjusted))


def _adjusted_parts(s: Study, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adjusted weights of rows of the slice, summed over keys before any join.

    The cap looks at the whole of a consumer's year, so its totals are taken from
    all rows of the year, not only the slice's.
    """
    parts = combine_parts(rows, [*cap.KEYS, "source_country_iso3c", *by])
    weight = parts.schema[TONNES].dataType
    factors = _outliers(s, s.slice_year).select(*cap.KEYS, "factor")
    scaled = parts.join(factors, list(cap.KEYS), "left").withColumn(
        TONNES, cap.scaled(F.col(TONNES), F.col("factor"), weight)
    )
    return _with_places(s, scaled.drop("factor"))


# -- foreign supply of one year ------------------------------------------------


def foreign_consumption_2019(s: Study) -> DataFrame:
    parts = _adjusted_parts(s, s.consumption().where(in_slice(s)), ["habitat", "method"])
    return parts.groupBy("consumer_iso3c", "source_country_iso3c", "habitat", "method").agg(
        narm_sum(TONNES).alias(TONNES)
    )


def foreign_flow(s: Study, source: str) -> DataFrame:
    """Flows of one source category between source and consumer country."""
    habitat, method = source.split(" ")
    flows = foreign_consumption_2019(s).where((F.col("habitat") == habitat) & (F.col("method") == method))
    return flows.groupBy("consumer_iso3c", "source_country_iso3c").agg(strict_sum(TONNES).alias(TONNES))


def _species_parts(s: Study) -> DataFrame:
    parts = _adjusted_parts(s, s.species_slice(), ["habitat", "method", "sciname_hs_modified"])
    return (
        parts.withColumn("habitat_method", habitat_method_text("habitat", "method"))
        .groupBy("sciname_hs_modified", "habitat_method", "source_region", "consumer_region")
        .agg(F.sum(TONNES).alias(TONNES), F.sum("n_missing").alias("n_missing"))
    )


def _top_species(s: Study, parts: DataFrame) -> DataFrame:
    # Ranks include the effect of a species having several common names.
    named = _with_common_names(s, parts)
    totals = named.groupBy("sciname_hs_modified", "habitat_method").agg(cap.complete_sum(TONNES).alias(TONNES))
    return top_k(totals, ["habitat_method"], TONNES, 5).select("sciname_hs_modified", "habitat_method")


def top_scinames_foreign_consumed(s: Study) -> DataFrame:
    """Five largest species per category, ties kept. "unknown" is not folded."""
    return _top_species(s, _species_parts(s))


def top_scinames_source_consumer(s: Study) -> DataFrame:
    """Flows of the leading species between regions, once per end of the flow."""
    parts = _species_parts(s)
    keys = ["sciname_hs_modified", "habitat_method"]
    named = _with_common_names(s, parts).alias("p")
    top = _top_species(s, parts).alias("t")
    flows = (
        named.join(top, [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left_semi")
        .withColumnsRenamed({"source_region": "Producer", "consumer_region": "Consumer"})
        .groupBy("common_name", "habitat_method", "Producer", "Consumer")
        .agg(cap.complete_sum(TONNES).alias(TONNES))
    )
    return long(flows, ["Consumer", "Producer"], "flow", "region")


def top_scinames(s: Study, source: str) -> DataFrame:
    """Leading species of one category with total and order. The total counts both
    ends of each flow."""
    flows = top_scinames_source_consumer(s).where(F.col("habitat_method") == source)
    by = ["habitat_method"]
    return group_total(flows, [*by, "common_name"], TONNES, "total").withColumn(
        "common_name_order", order_by_measure(by, F.col("total").desc(), "common_name")
    )


# -- supply --------------------------------------------------------------------


def _supply_parts(s: Study) -> DataFrame:
    """Adjusted weights by consumer, source category, origin and year.

    One pass over consumption: sums over keys come first, and the cap is worked out
    on the sums. Weights of dropped regions still count towards a consumer's total.
    """
    rows = lookup(
        s.consumption(), s.tables.countries, {"source_country_iso3c": "iso3c"}, {"source_region": "owid_region"},
        unique="countries",
    ).withColumn("in_region", F.coalesce(is_known_region("source_region"), F.lit(False)))
    parts = combine_parts(rows, [*cap.KEYS, "habitat", "method", "consumption_source", "in_region"])
    weight = parts.schema[TONNES].dataType
    consumer_year = Window.partitionBy(*cap.KEYS)
    parts = parts.withColumn("total_t", cap.complete_sum(TONNES, consumer_year))
    people = {"consumer_iso3c": "iso3c", "year": "year"}
    parts = lookup(parts, s.tables.population, people, {"pop": "pop"}, unique="population")
    parts = lookup(
        parts, s.tables.countries, {"consumer_iso3c": "iso3c"}, {"consumer_region": "owid_region"}, unique="countries"
    )
    factor = cap.cap_factor(F.col("total_t"), F.col("pop"), weight, s.max_kg_per_capita)
    return parts.where(F.col("in_region") & is_known_region("consumer_region")).withColumn(
        TONNES, cap.scaled(F.col(TONNES), factor, weight)
    )


def supply(s: Study) -> DataFrame:
    """Supply of each country by source category and year, split by origin."""
    if s.supply_table is not None:
        return s.supply_table
    label = consumption_source_label("consumption_source")
    totals = (
        _supply_parts(s)
        .groupBy(F.col("consumer_iso3c").alias("iso3c"), "habitat", "method", "year")
        .agg(
            sum_where(label == "domestic_consumption_t", TONNES).alias("supply_domestic"),
            sum_where(label == "foreign_consumption_t", TONNES).alias("supply_foreign"),
        )
        .withColumn("supply", F.col("supply_domestic") + F.col("supply_foreign"))
        .where(F.col("supply") > 0)
        .withColumn("habitat_method", habitat_method("habitat", "method"))
    )
    return lookup(
        totals, s.population(), {"iso3c": "iso3c", "year": "year"}, {"region": "region", "pop": "pop"}, unique="population"
    )


def _supply_sum(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(strict_sum("supply").alias("supply"))


def global_pop(s: Study) -> DataFrame:
    return s.population().where(is_known_region("region")).groupBy("year").agg(narm_sum("pop").alias("pop"))


def regional_pop(s: Study) -> DataFrame:
    return s.population().groupBy("region", "year").agg(strict_sum("pop").alias("pop"))


def global_supply_per_cap(s: Study) -> DataFrame:
    totals = lookup(_supply_sum(supply(s), "year"), global_pop(s), {"year": "year"}, {"pop": "pop"})
    return totals.withColumn("per_cap", kg_per_capita("supply", "pop"))


def supply_total(s: Study) -> DataFrame:
    return supply(s).groupBy("iso3c", "region", "year", "habitat_method").agg(
        *[strict_sum(c).alias(c) for c in ("supply", "supply_domestic", "supply_foreign", "pop")]
    )


def _regional_supply(s: Study) -> DataFrame:
    return supply(s).where(is_known_region("region"))


def supply_per_cap_by_source(s: Study) -> DataFrame:
    totals = _supply_sum(_regional_supply(s), "year", "habitat_method")
    totals = lookup(totals, global_pop(s), {"year": "year"}, {"year_global_pop": "pop"})
    return totals.withColumn("supply_per_cap", kg_per_capita("supply", "year_global_pop"))


def supply_per_cap_by_region(s: Study) -> DataFrame:
    totals = _supply_sum(_regional_supply(s), "year", "region", "habitat_method")
    totals = lookup(totals, regional_pop(s), {"region": "region", "year": "year"}, {"pop": "pop"})
    return totals.withColumn("supply_per_cap", kg_per_capita("supply", "pop"))


def _origin_percent(s: Study, *by: str) -> DataFrame:
    total = strict_sum("supply")
    shares = _regional_supply(s).groupBy(*by).agg(
        percent(strict_sum("supply_domestic"), total).alias("supply_domestic"),
        percent(strict_sum("supply_foreign"), total).alias("supply_foreign"),
    )
    return long(shares, ["supply_domestic", "supply_foreign"], "supply_source", "supply_percent").withColumn(
        "supply_source", F.regexp_replace("supply_source", "supply_", "")
    )


def supply_origin_percent(s: Study) -> DataFrame:
    return _origin_percent(s, "year")


def regional_supply_origin_percent(s: Study) -> DataFrame:
    return _origin_percent(s, "region", "year")


def global_supply(s: Study) -> DataFrame:
    """Supply per year in million tonnes."""
    return supply(s).groupBy("year").agg(millions(strict_sum("supply")).alias("supply"))


def regional_method_supplies(s: Study) -> DataFrame:
    """Percent of each region's 2020 supply by production method."""
    methods = _supply_sum(supply(s).where(F.col("year") == 2020), "year", "region", "method")
    shares = share_of_group(methods, ["year", "region"], "supply", "percent_supply", total="region_supply")
    return wide(
        shares, ["region", "region_supply"], "method", ["aquaculture", "capture", "unknown"], F.first("percent_supply")
    )


def method_supplies(s: Study) -> DataFrame:
    """Percent of the world's 2020 supply by production method."""
    methods = _supply_sum(supply(s).where(F.col("year") == 2020), "method")
    return share_of_all(methods, "supply", "percent_supply", "total_supply")


def habitat_method_supply(s: Study) -> DataFrame:
    totals = _supply_sum(supply(s), "year", "habitat", "method")
    return share_of_group(totals, ["year"], "supply", "percent_supply", total="supply_total")


def consumption_foreign(s: Study) -> DataFrame:
    return (
        supply(s)
        .where(F.col("year").isin(1996, 2020))
        .groupBy("year")
        .agg(strict_sum("supply_foreign").alias("supply_foreign"), strict_sum("supply").alias("supply"))
        .withColumn("percent_supply", percent("supply_foreign", "supply"))
    )


def regular_consumption(s: Study) -> DataFrame:
    """Rows of consumer-years that are not outliers."""
    return without_keys(consumption_rows(s), _outliers(s), cap.KEYS)


def adjusted_by_union(s: Study) -> DataFrame:
    """Rows of regular consumer-years stacked on the corrected rows of the others.

    The two-step form of the cap, for checking one against the other.
    """
    label = F.concat_ws("_", "consumer_iso3c", "year")
    return stack(regular_consumption(s).withColumn("consumer_year", label), consumption_scaled(s))
