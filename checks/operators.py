"""One query per building block, run over the whole fixture tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tradeweave.functions import columns as c
from tradeweave.functions import domains as d
from tradeweave.functions.aggregates import narm_sum, strict_sum, sum_where, year_slope
from tradeweave.operators import joins, network, reshape, windows
from tradeweave.plans import headline, lastmile, study, supply, trade
from tradeweave.plans.study import Study
from tradeweave.sources import sinks
from tradeweave.sources.regimes import in_regime_table
from tradeweave.sources.tables import TradeTables, list_tables, read_csv, read_csv_checked, register, row_counts

WEIGHT, TONNES = trade.WEIGHT, supply.TONNES
OPERATORS: dict[str, Callable[[Study], DataFrame]] = {}


def operator(f: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    OPERATORS[f.__name__] = f
    return f


def _count(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# -- scans, sources, sinks -----------------------------------------------------


@operator
def scan_trade_regime(s):
    return s.tables.snet.where(c.in_regime("hs_version", "year"))


@operator
def scan_consumption_regime(s):
    return study.consumption_rows(s)


@operator
def scan_production(s):
    return s.tables.production.drop("record_id")


@operator
def scan_countries(s):
    return s.tables.countries.drop("record_id")


@operator
def scan_code_max_resolved_taxa(s):
    return study.pad_codes(s.tables.code_max_resolved_taxa.drop("record_id"))


@operator
def scan_sciname(s):
    return s.tables.sciname.drop("record_id")


@operator
def scan_population(s):
    return s.tables.population.drop("record_id")


@operator
def scan_aggregate_pushdown(s):
    return trade.trade_ts_by_version(s)


@operator
def table_rows(s):
    return row_counts(s.tables)


@operator
def catalog(s):
    """Tables, columns and types as the session's catalog lists them, with the rows that
    are read back from it. The views go again; plans made from them stay."""
    spark = s.tables.snet.sparkSession
    prefix = f"t{uuid.uuid4().hex}_"
    names = register(s.tables, prefix)
    try:
        listed = list_tables(spark, pattern=f"{prefix}*")
        counts = row_counts(TradeTables.from_catalog(spark, prefix=prefix))
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
    listed = listed.withColumn("table_name", F.substring("table_name", len(prefix) + 1, 99))
    return joins.lookup(listed, counts, {"table_name": "table_name"}, {"n_rows": "n_rows"}).select(
        "table_name", "position", "column_name", "data_type", "n_rows"
    )


@operator
def scan_trade_laid_out(s):
    """Trade stored by version and year, of the versions that a table names."""
    snet, regimes = s.tables.laid_out()
    return in_regime_table(snet, regimes)


@operator
def custom_regime_exports(s):
    """Exports by category where other versions count than the published ones."""
    _, regimes = s.tables.laid_out()
    return trade.export_by_source(replace(s, regimes=regimes, regime="late"))


def _through_csv(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = sinks.passing_folder(spark, name)
    sinks.write_csv(df, path)
    return read_csv(spark, path, df.schema)


@operator
def read_csv_table(s):
    return _through_csv(s.tables.population, "population_csv")


@operator
def write_csv_table(s):
    return _through_csv(trade.dom_export_by_source(s), "dom_export_csv")


@operator
def read_csv_rejected(s):
    """Customers written as lines of CSV, some of which do not fit: what is read, and what is set aside."""
    lines = s.tables.csv_lines()
    spark = lines.sparkSession
    path = sinks.passing_folder(spark, "lines_csv")
    lines.write.text(path)
    schema = StructType([StructField("record_id", LongType()), StructField("iso3c", StringType()), StructField("pop", LongType())])
    checked = read_csv_checked(spark, path, schema, header=False)
    return reshape.stack(checked.rows, checked.rejected.select("record"))


@operator
def centroid_source(s):
    return s.tables.centroids


# -- projections, filters, predicates ------------------------------------------


@operator
def drop_null_weights(s):
    return study.weighed_rows(s)


@operator
def normalize_hs6(s):
    return _count(study.pad_codes(s.tables.snet), "hs6")


@operator
def split_nonfood(s):
    return study.nonfood_trade(s)


@operator
def split_food(s):
    return study.food_rows(s)


@operator
def fishmeal_filter(s):
    return study.fishmeal_rows(s)


@operator
def min_weight_filter(s):
    return s.tables.snet.where(F.col(WEIGHT) >= d.MIN_WEIGHT_T).select("record_id", WEIGHT)


@operator
def habitat_method(s):
    return _count(
        s.tables.snet,
        "habitat",
        "method",
        c.habitat_method("habitat", "method").alias("trade_source"),
        c.habitat_method("habitat", "method", fold_unknown=False).alias("production_source"),
    )


@operator
def filter_rows(s):
    rows = s.tables.snet.where(
        (F.col("dom_source") != "error")
        & F.col("hs6").isNotNull()
        & ((F.col("year") < 2000) | (F.col("year") > 2015))
        & (F.col("product_weight_t") <= 40)
    )
    return rows.select("record_id", "year", "dom_source", "hs6")


@operator
def year_in_range(s):
    return _count(s.tables.snet.where(c.in_year_groups("year")), "year")


@operator
def select_columns(s):
    return s.tables.countries.select(F.col("iso3c").alias("exporter_iso3c"), F.col("owid_region").alias("exporter_region"))


@operator
def rename_columns(s):
    return s.tables.consumption.withColumnsRenamed({"consumer_iso3c": "iso3c", TONNES: "supply"}).select(
        "record_id", "iso3c", "supply"
    )


@operator
def mutate(s):
    return s.tables.consumption.withColumn("consumption_kg", F.col(TONNES) * 1000).select("record_id", "consumption_kg")


@operator
def case_when(s):
    size = F.when(F.col(WEIGHT) < 1, "trace").when(F.col(WEIGHT) < 10000, "small").when(F.col(WEIGHT) < 50000, "medium")
    return _count(s.tables.snet, size.alias("size_class"))


@operator
def food_or_fmfo(s):
    return _count(study.pad_codes(s.tables.snet), "hs6", c.food_or_fmfo(F.col("hs6") == d.FISHMEAL_CODE).alias("food_or_fmfo"))


@operator
def year_group(s):
    return _count(s.tables.snet, "year", c.year_group("year").alias("year_group"))


@operator
def ldc_flag(s):
    return _count(
        s.tables.snet,
        "exporter_iso3c",
        "importer_iso3c",
        c.ldc_flag("exporter_iso3c", s.ldc_codes).alias("exporter_ldc"),
        c.ldc_flag("importer_iso3c", s.ldc_codes).alias("importer_ldc"),
    )


@operator
def intraregion_flag(s):
    scope = c.trade_scope("exporter_region", "importer_region")
    return _count(s.trade_with_regions(), "exporter_region", "importer_region", scope.alias("intraregion"))


@operator
def exporter_importer_label(s):
    label = c.pair_label("exporter_region", "importer_region")
    return _count(s.trade_with_regions(), label.alias("exporter_importer"))


@operator
def consumption_source_recode(s):
    return _count(s.tables.consumption, c.consumption_source_label("consumption_source").alias("consumption_source"))


@operator
def unit_scaling(s):
    total = trade.export_by_source(s)
    return total.select(
        "year",
        "habitat_method",
        (F.col(WEIGHT) * 1000).alias("live_weight_kg"),
        c.millions(WEIGHT).alias("live_weight_mt"),
        (-c.millions(WEIGHT)).alias("negative_mt"),
    )


@operator
def replace_na(s):
    totals = reshape.wide(
        s.tables.consumption, ["consumer_iso3c", "year"], "consumption_source", ["domestic", "foreign"], F.sum(TONNES)
    )
    return totals.na.fill(0, ["domestic", "foreign"])


@operator
def factor_relevel(s):
    return _count(
        s.tables.snet,
        c.restrict_to(c.habitat_method_text("habitat", "method"), d.FOUR_SOURCES).alias("level"),
        c.level_order(c.habitat_method_text("habitat", "method"), d.FOUR_SOURCES).alias("level_order"),
    )


@operator
def hs_version_factor(s):
    return lastmile.hs_version_series(s)


# -- joins ---------------------------------------------------------------------


@operator
def dimension_contract(s):
    """How the keys of the dimensions hold; only species may have several rows."""
    t = s.tables
    return reshape.stack(
        joins.key_report(t.countries, ["iso3c"], "countries"),
        joins.key_report(t.population, ["iso3c", "year"], "population"),
        joins.key_report(t.sciname, ["sciname"], "sciname"),
        joins.key_report(t.consumption, ["consumer_iso3c", "year"], "consumption"),
    )


@operator
def population_region(s):
    return s.population()


@operator
def add_region(s):
    return study.add_regions(s.tables.snet, s.tables.countries).select(
        "record_id", "exporter_iso3c", "exporter_region", "importer_iso3c", "importer_region"
    )


@operator
def add_common_name(s):
    return supply._with_common_names(s, s.tables.consumption).select("record_id", "sciname_hs_modified", "common_name")


@operator
def join_production_share(s):
    return trade.percent_export_by_source(s)


@operator
def join_production_year(s):
    s = s.with_shared_sources()
    exported = s.trade_by_source().groupBy("year").agg(strict_sum(WEIGHT).alias(WEIGHT))
    produced = trade.prod_by_source(s).groupBy("year").agg(strict_sum("production_t").alias("production_t"))
    return joins.lookup(exported, produced, {"year": "year"}, {"production_t": "production_t"})


@operator
def degree_full_join(s):
    out = network.degree_of(s.trade(), ["year", "habitat_method"], network.SOURCE, "all_out_degree")
    into = network.degree_of(s.trade(), ["year", "habitat_method"], network.TARGET, "all_in_degree")
    return joins.full_on(out, into, ["year", "iso3c", "habitat_method"])


@operator
def join_population(s):
    totals = s.tables.consumption.groupBy("consumer_iso3c", "year").agg(strict_sum(TONNES).alias(TONNES))
    return joins.lookup(totals, s.tables.population, {"consumer_iso3c": "iso3c", "year": "year"}, {"pop": "pop"})


@operator
def join_outlier_detail(s):
    return supply.consumption_scaled(s)


@operator
def anti_outliers(s):
    return _count(supply.regular_consumption(s), "consumer_iso3c", "year")


@operator
def join_top_species(s):
    return supply.top_scinames_source_consumer(s)


@operator
def join_global_pop(s):
    return supply.global_supply_per_cap(s)


@operator
def join_regional_pop(s):
    return supply.supply_per_cap_by_region(s)


@operator
def join_slopes(s):
    return joins.lookup(
        trade.region_flows(s), trade.region_slopes(s), {"exporter_importer": "exporter_importer"}, {"slope": "slope"}
    )


@operator
def join_ldc_flows(s):
    flows = trade.ldc_habitat_method_summary(s)
    inward = flows.where((F.col("importer_ldc") == "LDC") & (F.col("exporter_ldc") == "non-LDC"))
    outward = flows.where((F.col("importer_ldc") == "non-LDC") & (F.col("exporter_ldc") == "LDC"))
    return joins.lookup(
        inward.select("year", "habitat_method", F.col(WEIGHT).alias("ldc_import")),
        outward,
        {"year": "year", "habitat_method": "habitat_method"},
        {"ldc_export": WEIGHT},
        null_safe=["habitat_method"],
    )


@operator
def region_net_join(s):
    return lastmile.region_net_import(s)


@operator
def join_centroids(s):
    points = lastmile.country_centroids(s)
    pairs = _count(s.trade(), "exporter_iso3c", "importer_iso3c")
    pairs = joins.lookup(
        pairs, points, {"exporter_iso3c": "iso3"}, {"exporter_lon": "centroid_lon", "exporter_lat": "centroid_lat"}
    )
    return joins.lookup(
        pairs, points, {"importer_iso3c": "iso3"}, {"importer_lon": "centroid_lon", "importer_lat": "centroid_lat"}
    )


@operator
def join_map_attributes(s):
    return lastmile.map_attributes(s)


# -- aggregations --------------------------------------------------------------


@operator
def group_sum(s):
    return s.tables.snet.groupBy("year").agg(strict_sum("product_weight_t").alias("product_weight_t"))


@operator
def group_sum_narm(s):
    return s.tables.snet.groupBy("year", "exporter_iso3c", "hs6").agg(
        narm_sum("product_weight_t").alias("product_weight_t")
    )


@operator
def group_mean(s):
    return s.tables.snet.groupBy("year", "dom_source").agg(
        c.ratio(F.sum("product_weight_t"), F.count("product_weight_t")).alias("mean_product_weight_t"),
        F.avg("hs6").alias("mean_hs6"),
    )


@operator
def count_rows(s):
    return _count(s.tables.snet, "year", "hs_version")


@operator
def distinct_rows(s):
    return network.edges(s.trade(), ["year", "habitat_method"])


@operator
def nrow_ratio(s):
    return headline.percent_flow_increases(s)


@operator
def global_max(s):
    return lastmile.axis_limits(s)


@operator
def argmax_row(s):
    return headline.max_supply_share(s)


@operator
def argmin_row(s):
    farmed = supply.habitat_method_supply(s).where((F.col("method") == "aquaculture") & (F.col("percent_supply") > 10))
    return windows.rows_at_min(farmed, "year").select("year", "habitat", "percent_supply")


@operator
def sum_of_ratio_parts(s):
    return supply.regional_supply_origin_percent(s)


@operator
def ols_slope_by_group(s):
    yearly = s.trade().groupBy("exporter_iso3c", "importer_iso3c", "year").agg(strict_sum(WEIGHT).alias(WEIGHT))
    return yearly.groupBy("exporter_iso3c", "importer_iso3c").agg(year_slope(WEIGHT).alias("slope"))


# -- windows, sorts, top-k -----------------------------------------------------


@operator
def cumulative_share(s):
    weights = s.trade().groupBy("year", "exporter_iso3c").agg(strict_sum(WEIGHT).alias(WEIGHT))
    return windows.cumulative_share(weights, ["year"], WEIGHT, tie_break="exporter_iso3c")


@operator
def share_of_group(s):
    return headline.dom_source_shares(s)


@operator
def group_total_column(s):
    return windows.group_total(trade.export_by_source(s), ["habitat_method"], WEIGHT, "total")


@operator
def average_rank(s):
    partners = network.degrees(s.trade(), ["year"])
    return partners.withColumn("ranking", windows.average_rank("all_out_degree", ["year"]))


@operator
def top_k_by_group(s):
    partners = network.degrees(s.trade(), ["year"])
    return windows.top_k(partners, ["year"], "all_in_degree", 5)


@operator
def sort_rows(s):
    return trade.export_concentration(s).orderBy("year", "habitat_method", F.col(WEIGHT).desc(), "exporter_iso3c")


@operator
def top_k_global(s):
    partners = network.degrees(s.trade(), ["year", "habitat_method"])
    return windows.top_k(partners, [], "all_out_degree", 10)


@operator
def order_by_other_column(s):
    means = trade.region_flows(s).groupBy("exporter_region").agg(
        c.ratio(strict_sum(WEIGHT), F.count(F.lit(1))).alias("mean_weight")
    )
    return means.withColumn("region_order", windows.order_by_measure([], F.col("mean_weight").desc(), "exporter_region"))


@operator
def order_within_group(s):
    top = trade.top_importers_total_old(s)
    return top.select(
        "habitat_method",
        F.col("importer_iso3c").alias("label"),
        c.within_value("importer_iso3c").alias("iso3c"),
        windows.order_by_measure(["habitat_method"], "ranking", "importer_iso3c").alias("label_order"),
    )


# -- set operations and reshaping ----------------------------------------------


@operator
def union_all_by_name(s):
    return supply.adjusted_by_union(s)


@operator
def union_tagged(s):
    return trade.percent_export_total(s)


@operator
def subtotal_union(s):
    return reshape.with_total_rows(trade.export_by_source(s), "habitat_method").groupBy("year", "habitat_method").agg(
        strict_sum(WEIGHT).alias(WEIGHT)
    )


@operator
def pivot_wider(s):
    return reshape.wide(
        s.trade(), ["year", "exporter_iso3c"], "dom_source", d.DOM_SOURCES, strict_sum(WEIGHT), fill=0, prefix="from_"
    )


@operator
def pivot_longer(s):
    return lastmile.top_partners_long(trade.top_exporters_new(s))


@operator
def pivot_longer_names_sep(s):
    flows = trade.region_method_flows(s).drop("exporter_importer")
    return reshape.long_split(flows, ["exporter_region", "importer_region"], ["flow", "drop"], "region", "_")


@operator
def sankey_links(s):
    return reshape.flow_links(trade.region_method_flows(s), ["exporter_region", "importer_region"], WEIGHT)


# -- scalar functions ----------------------------------------------------------


@operator
def str_concat(s):
    return s.tables.consumption.select(
        "record_id",
        F.concat_ws("_", "consumer_iso3c", "year").alias("consumer_year"),
        c.habitat_method_text("habitat", "method").alias("habitat_method"),
    )


@operator
def str_length(s):
    text = F.col("hs6").cast("string")
    return _count(s.tables.snet, F.length(text).alias("n_chars"))


@operator
def str_count_chars(s):
    return s.tables.centroids.where(F.length("adm1_code") == 3).select("iso3", "adm1_code")


@operator
def str_detect(s):
    text = c.habitat_method_text("habitat", "method")
    return s.tables.snet.groupBy("year").agg(
        sum_where(text.contains("capture"), WEIGHT).alias("capture"),
        sum_where(text.contains("marine capture"), WEIGHT).alias("marine_capture"),
        sum_where(text.contains("unknown"), WEIGHT).alias("unknown"),
    )


@operator
def regex_replace(s):
    return s.tables.sciname.select(
        "sciname", F.regexp_replace("common_name", " nei", "").alias("name"),
        F.regexp_replace(F.regexp_replace("common_name", " nei", ""), " ", "\n").alias("stacked"),
    )


@operator
def cast_text(s):
    return _count(s.tables.snet, F.col("hs6").cast("string").alias("hs6"))


@operator
def round_digits(s):
    return trade.percent_export_by_source(s).select(
        "year", "habitat_method", "environment",
        c.round_even("percent_export", 1).alias("one_digit"), c.round_even("percent_export").alias("no_digit"),
    )


@operator
def signif_digits(s):
    return supply.supply_per_cap_by_region(s).select(
        "year", "region", "habitat_method", c.signif("supply_per_cap", 3).alias("three"), c.signif("supply_per_cap", 2).alias("two")
    )


@operator
def abs_value(s):
    return trade.bilateral_flow_change(s).select("exporter_iso3c", "importer_iso3c", F.abs("change").alias("change"))


@operator
def percent_change(s):
    return trade.bilateral_flow_change(s).select(
        "exporter_iso3c", "importer_iso3c",
        c.percent_change("beginning", "end").alias("of_start"),
        c.percent_change("beginning", "end", base=F.col("end")).alias("of_end"),
    )


@operator
def is_null(s):
    return s.tables.snet.groupBy("year").agg(
        F.count_if(F.col("hs6").isNull()).alias("no_code"), F.count_if(F.col("product_weight_t").isNull()).alias("no_weight")
    )


@operator
def in_list(s):
    codes = study.pad_codes(s.tables.snet)
    return codes.groupBy("year").agg(
        F.count_if(F.col("hs6").isin(*d.NONFOOD_CODES)).alias("listed"),
        F.count_if(c.not_in("hs6", d.NONFOOD_CODES)).alias("not_listed"),
    )


# Keys that are not Python-friendly names for a function above.
for old, new in (
    ("table_rows", "row_counts"),
    ("catalog", "list_tables"),
    ("read_csv_table", "read_csv"),
    ("write_csv_table", "write_csv"),
    ("filter_rows", "filter"),
    ("select_columns", "select"),
    ("rename_columns", "rename"),
):
    OPERATORS[new] = OPERATORS.pop(old)
