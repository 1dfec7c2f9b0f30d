"""Datasets about the trade network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions import domains as d
from tradeweave.functions.aggregates import narm_sum, strict_sum, year_slope
from tradeweave.functions.columns import (
    habitat_method,
    in_regime,
    in_year_groups,
    is_known_region,
    ldc_flag,
    pair_label,
    percent,
    trade_scope,
    within_label,
    year_group,
)
from tradeweave.operators.concentration import concentration, n_below
from tradeweave.operators.joins import lookup
from tradeweave.operators.network import degrees, degrees_from_sets
from tradeweave.operators.reshape import wide
from tradeweave.operators.windows import average_rank, group_total, order_by_measure, top_k
from tradeweave.plans.study import Study, add_regions, fishmeal_rows, source_totals
from tradeweave.sources.regimes import in_regime_table

WEIGHT = "live_weight_t"
EXPORTER, IMPORTER = "exporter_iso3c", "importer_iso3c"


def _sum(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(strict_sum(WEIGHT).alias(WEIGHT))


# -- volumes and shares --------------------------------------------------------


def fishmeal_trade(s: Study) -> DataFrame:
    if s.version_cube is not None:
        met = s.version_cube.where(F.col("n_fishmeal") > 0).groupBy("year")
        return met.agg(
            F.sum("fishmeal_live_t").alias(WEIGHT), F.sum("fishmeal_product_t").alias("product_weight_t")
        )
    return (
        fishmeal_rows(s)
        .groupBy("year")
        .agg(narm_sum(WEIGHT).alias(WEIGHT), narm_sum("product_weight_t").alias("product_weight_t"))
    )


def global_export_by_source(s: Study) -> DataFrame:
    return _sum(s.trade(), "year", "habitat_method", "food_or_fmfo")


def export_by_source(s: Study) -> DataFrame:
    return _sum(s.trade(), "year", "habitat_method")


def prod_summary(s: Study) -> DataFrame:
    if s.production_cube is not None:
        return s.production_cube
    return s.tables.production.groupBy("year", "iso3c", "sciname", "method", "habitat").agg(
        narm_sum(WEIGHT).alias("production_t")
    )


def prod_by_source(s: Study) -> DataFrame:
    """Production by year and category. There is no "unknown" level here, so such
    production has a missing category and may take several rows per year."""
    return (
        source_totals(s).select("year", "production_t", habitat_method("habitat", "method", fold_unknown=False).alias("habitat_method"))
    )


def dom_export_by_source(s: Study) -> DataFrame:
    return (
        s.trade_by_source()
        .where(F.col("dom_source") == "domestic")
        .groupBy("year", "habitat_method", "environment")
        .agg(strict_sum(WEIGHT).alias("dom_live_weight_t"))
    )


def _domestic_with_production(s: Study) -> DataFrame:
    s = s.with_shared_sources()
    return lookup(
        dom_export_by_source(s),
        prod_by_source(s),
        {"year": "year", "habitat_method": "habitat_method"},
        {"production_t": "production_t"},
        null_safe=["habitat_method"],
    )


def percent_export_by_source(s: Study) -> DataFrame:
    return _domestic_with_production(s).withColumn("percent_export", percent("dom_live_weight_t", "production_t"))


def export_shares(s: Study, sources: Sequence[str] = ()) -> DataFrame:
    """Per year: exports and production, of domestic origin and of all, and the share
    of domestic production exported of each of the given categories.

    ``domestic_production`` is missing in years with an unmatched category. All comes
    from one pass over trade and one over production, or one over both: everything
    after the first sums is a few rows per year.
    """
    s = s.with_shared_sources()
    domestic = F.when(F.col("dom_source") == "domestic", F.col(WEIGHT))
    exports = s.trade_by_source().groupBy("year", "habitat_method", "environment").agg(
        F.sum(domestic).alias("domestic"), strict_sum(WEIGHT).alias("everything")
    )
    exports = group_total(exports, ["year"], "everything", "everything_year")
    production = prod_by_source(s)
    matched = lookup(
        exports,
        production,
        {"year": "year", "habitat_method": "habitat_method"},
        {"production_t": "production_t"},
        null_safe=["habitat_method"],
    )
    exported, produced = F.col("domestic"), F.when(F.col("domestic").isNotNull(), F.col("production_t"))
    yearly = matched.groupBy("year").agg(
        F.sum(exported).alias("domestic"),
        F.when(F.count(exported) == F.count(produced), F.sum(produced)).alias("domestic_production"),
        F.max("everything_year").alias("everything"),
        *[F.max(F.when(F.col("habitat_method") == c, percent(exported, produced))).alias(c) for c in sources],
    )
    totals = production.groupBy("year").agg(strict_sum("production_t").alias("production_t"))
    return lookup(yearly, totals, {"year": "year"}, {"production": "production_t"})


def percent_export_total(s: Study) -> DataFrame:
    """Share of production exported per year, domestic origin only and all origins.

    The domestic share is missing in years with an unmatched category.
    """

    def series(calc_type: str, part: str, whole: str) -> Column:
        return F.struct(percent(part, whole).alias("percent_export"), F.lit(calc_type).alias("calc_type"))

    both = F.array_compact(
        F.array(
            F.when(F.col("domestic").isNotNull(), series("domestic exports", "domestic", "domestic_production")),
            series("all export sources", "everything", "production"),
        )
    )
    return export_shares(s).select("year", F.explode(both).alias("series")).select("year", "series.*")


# -- network -------------------------------------------------------------------


def all_degree_summary(s: Study) -> DataFrame:
    if s.edge_table is not None:
        return degrees_from_sets(s.edge_table, ["year"], "habitat_method", d.HABITAT_METHODS, "all")
    return degrees(s.trade(), ["year"])


def habitat_method_degree_summary(s: Study) -> DataFrame:
    """Degrees within each category; an edge is shuffled once with all its categories."""
    return degrees_from_sets(s.edges(), ["year"], "habitat_method", d.HABITAT_METHODS, "within")


def degree_levels(s: Study) -> DataFrame:
    """Both degree summaries in one table, counted from one set of edges."""
    return degrees_from_sets(s.edges(), ["year"], "habitat_method", d.HABITAT_METHODS, "both")


def bilateral_habitat_method_summary(s: Study) -> DataFrame:
    """Weights of the trade network. Regions are looked up after the sum: they
    depend on the country alone."""
    weights = _sum(s.edible_trade(), "year", EXPORTER, IMPORTER, "habitat_method", "dom_source")
    return add_regions(weights, s.tables.countries)


def country_concentration(s: Study, member: str) -> DataFrame:
    return concentration(s.edible_trade(), ["year", "habitat_method"], member)


def concentration_n_countries(s: Study, member: str) -> DataFrame:
    return n_below(concentration(s.edible_trade(), ["year"], member), ["year"], s.concentration_percent)


def n_countries_by_flow(s: Study) -> DataFrame:
    """Exporting and importing countries behind the first three quarters of each year's
    trade, from one pass over it: pairs of countries first, then both ends of each."""
    pairs = s.edible_trade().groupBy("year", EXPORTER, IMPORTER).agg(strict_sum(WEIGHT).alias(WEIGHT))
    ends = F.array(
        F.struct(F.lit("export").alias("flow"), F.col(EXPORTER).alias("country")),
        F.struct(F.lit("import").alias("flow"), F.col(IMPORTER).alias("country")),
    )
    members = pairs.select("year", WEIGHT, F.explode(ends).alias("end")).select("year", WEIGHT, "end.*")
    by = ["year", "flow"]
    return n_below(concentration(members, by, "country"), by, s.concentration_percent)


def concentration_n_countries_by_source(s: Study, member: str) -> DataFrame:
    by = ["year", "habitat_method"]
    return n_below(concentration(s.sourced_trade(), by, member), by, s.concentration_percent)


def export_concentration(s: Study) -> DataFrame:
    return country_concentration(s, EXPORTER)


def export_concentration_n_countries(s: Study) -> DataFrame:
    return concentration_n_countries(s, EXPORTER)


def export_concentration_n_countries_by_source(s: Study) -> DataFrame:
    return concentration_n_countries_by_source(s, EXPORTER)


def import_concentration(s: Study) -> DataFrame:
    return country_concentration(s, IMPORTER)


def import_concentration_n_countries(s: Study) -> DataFrame:
    return concentration_n_countries(s, IMPORTER)


def import_concentration_n_countries_by_source(s: Study) -> DataFrame:
    return concentration_n_countries_by_source(s, IMPORTER)


# -- regions -------------------------------------------------------------------


def region_method_flows(s: Study) -> DataFrame:
    flows = s.trade_with_regions().where(is_known_region("importer_region") & is_known_region("exporter_region"))
    return _sum(flows, "year", "exporter_region", "importer_region", "habitat_method").withColumn(
        "exporter_importer", pair_label("exporter_region", "importer_region")
    )


def regional_trade(s: Study) -> DataFrame:
    """Flows between regions, including missing and leftover ones."""
    return (
        s.trade_with_regions()
        .withColumnRenamed("environment", "habitat")
        .groupBy("exporter_region", "importer_region", "habitat", "method", "year")
        .agg(narm_sum(WEIGHT).alias(WEIGHT))
    )


def region_flows(s: Study) -> DataFrame:
    flows = s.trade_with_regions().where(is_known_region("importer_region") & is_known_region("exporter_region"))
    return _sum(flows, "year", "exporter_region", "importer_region").withColumn(
        "exporter_importer", pair_label("exporter_region", "importer_region")
    )


def region_slopes(s: Study) -> DataFrame:
    return region_flows(s).groupBy("exporter_importer").agg(year_slope(WEIGHT).alias("slope"))


def regional_avg_annual_change(s: Study) -> DataFrame:
    """One row per region pair: trend, scope, and the position by trend.

    The trend is grouped with the pair's own columns, so nothing is joined back.
    """
    pairs = (
        region_flows(s)
        .groupBy("exporter_region", "importer_region", "exporter_importer")
        .agg(year_slope(WEIGHT).alias("slope"))
        .withColumn("intraregion", trade_scope("exporter_region", "importer_region"))
    )
    position = order_by_measure([], F.col("slope").asc_nulls_last(), "exporter_importer")
    return pairs.withColumn("pair_order", position)


# -- change over time and leading countries ------------------------------------


def bilateral_flow_change(s: Study) -> DataFrame:
    flows = (
        add_regions(s.edible_trade().where(in_year_groups("year")), s.tables.countries)
        .where(is_known_region("exporter_region") & is_known_region("importer_region"))
        .withColumn("year_group", year_group("year"))
    )
    return (
        wide(flows, [EXPORTER, IMPORTER], "year_group", ["beginning", "end"], strict_sum(WEIGHT), fill=0)
        .withColumn("change", F.col("end") - F.col("beginning"))
        .orderBy(F.col("change").desc(), EXPORTER, IMPORTER)
    )


def _ranked(df: DataFrame, country: str) -> DataFrame:
    by = ["habitat_method"]
    return (
        top_k(df, by, WEIGHT, 10)
        .withColumn("ranking", average_rank(WEIGHT, by))
        .withColumn(country, within_label(country, "habitat_method"))
    )


def top_by_origin(s: Study, country: str, years: Sequence[int]) -> DataFrame:
    """Ten largest countries per category with their domestic and foreign weight.

    Products of erroneous origin have a column of their own and do not count.
    """
    trade = s.sourced_trade().where(F.col("year").between(*years))
    average = narm_sum(WEIGHT).cast("double") / F.lit(d.WINDOW_DIVISOR)
    totals = wide(trade, [country, "habitat_method"], "dom_source", d.DOM_SOURCES, average, fill=0)
    return _ranked(totals.withColumn(WEIGHT, F.col("domestic") + F.col("foreign")), country)


def top_by_total(s: Study, country: str, years: Sequence[int]) -> DataFrame:
    trade = s.sourced_trade().where(F.col("year").between(*years))
    average = narm_sum(WEIGHT).cast("double") / F.lit(d.WINDOW_DIVISOR)
    return _ranked(trade.groupBy(country, "habitat_method").agg(average.alias(WEIGHT)), country)


def top_exporters_old(s: Study) -> DataFrame:
    return top_by_origin(s, EXPORTER, d.BEGINNING_YEARS)


def top_exporters_new(s: Study) -> DataFrame:
    return top_by_origin(s, EXPORTER, d.END_YEARS)


def top_importers_old(s: Study) -> DataFrame:
    return top_by_origin(s, IMPORTER, d.BEGINNING_YEARS)


def top_importers_new(s: Study) -> DataFrame:
    return top_by_origin(s, IMPORTER, d.END_YEARS)


def top_importers_total_old(s: Study) -> DataFrame:
    return top_by_total(s, IMPORTER, d.BEGINNING_YEARS)


def top_importers_total_recent(s: Study) -> DataFrame:
    return top_by_total(s, IMPORTER, d.END_YEARS)


# -- origin and country groups -------------------------------------------------


def dom_source_ts(s: Study) -> DataFrame:
    return s.trade().groupBy("dom_source", "year").agg(narm_sum(WEIGHT).alias(WEIGHT))


def dom_source_by_habitat_method(s: Study) -> DataFrame:
    return (
        s.trade()
        .where(F.col("dom_source") != "error")
        .groupBy("dom_source", "habitat_method", "year")
        .agg(narm_sum(WEIGHT).alias(WEIGHT))
    )


def _with_ldc_groups(s: Study, trade: DataFrame) -> DataFrame:
    return trade.withColumns(
        {"exporter_ldc": ldc_flag(EXPORTER, s.ldc_codes), "importer_ldc": ldc_flag(IMPORTER, s.ldc_codes)}
    )


def ldc_habitat_method_summary(s: Study) -> DataFrame:
    return _sum(_with_ldc_groups(s, s.edible_trade()), "year", "exporter_ldc", "importer_ldc", "habitat_method")


def ldc_net_habitat_method_summary(s: Study) -> DataFrame:
    """Net trade of the least-developed group. Both directions come from one
    aggregate; rows without imports do not occur in the result."""
    inward = (F.col("importer_ldc") == "LDC") & (F.col("exporter_ldc") == "non-LDC")
    outward = (F.col("importer_ldc") == "non-LDC") & (F.col("exporter_ldc") == "LDC")
    return (
        _with_ldc_groups(s, s.sourced_trade())
        .groupBy("year", "habitat_method")
        .agg(
            F.sum(F.when(inward, F.col(WEIGHT))).alias("ldc_import"),
            F.sum(F.when(outward, F.col(WEIGHT))).alias("ldc_export"),
        )
        .where(F.col("ldc_import").isNotNull())
        .withColumns(
            {
                "net_import": F.col("ldc_import") - F.col("ldc_export"),
                "net_export": F.col("ldc_export") - F.col("ldc_import"),
            }
        )
    )


# -- product-code versions -----------------------------------------------------


def trade_ts_by_version(s: Study) -> DataFrame:
    """Product weight of every version and year, without any cleaning."""
    if s.version_cube is not None:
        return s.version_cube.select("year", "hs_version", "product_weight_t")
    return s.tables.snet.groupBy("year", "hs_version").agg(F.sum("product_weight_t").alias("product_weight_t"))


def custom_ts(s: Study) -> DataFrame:
    """The authoritative version of each year; the first has no lower bound."""
    series = trade_ts_by_version(s)
    if s.regimes is None:
        series = series.where(in_regime("hs_version", "year", open_start=True))
    else:
        series = in_regime_table(series, s.regimes, s.regime, open_start=True)
    return series.withColumn("hs_version", F.lit(s.custom_series_label))


def trade_ts_union(s: Study) -> DataFrame:
    """Every version's series plus the custom one, from a single scan."""
    series = trade_ts_by_version(s)
    counts = in_regime("hs_version", "year", open_start=True)
    if s.regimes is not None:
        series = in_regime_table(series, s.regimes, s.regime, open_start=True, mark="_counts")
        counts = F.col("_counts")
    both = F.when(counts, F.array(F.col("hs_version"), F.lit(s.custom_series_label))).otherwise(F.array("hs_version"))
    return series.withColumn("hs_version", F.explode(both)).select("year", "hs_version", "product_weight_t")
