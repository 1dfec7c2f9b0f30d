"""Tables behind the charts: stacked series, flow ends, labels and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions import domains as d
from tradeweave.functions.aggregates import narm_sum, strict_sum
from tradeweave.functions.columns import (
    abbreviate_region,
    chart_name,
    level_order,
    millions,
    restrict_to,
)
from tradeweave.operators.joins import lookup
from tradeweave.operators.reshape import flow_links, long, long_split, stack_tagged, with_total_rows
from tradeweave.operators.windows import top_k
from tradeweave.plans import supply, trade
from tradeweave.plans.study import Study, in_plan

WEIGHT, TONNES = trade.WEIGHT, supply.TONNES


def mean_degree_by_source(s: Study) -> DataFrame:
    """Average number of partners per year and source category, for both ends."""
    return (
        trade.habitat_method_degree_summary(s)
        .groupBy("year", "habitat_method")
        .agg(
            F.avg("all_out_degree").alias("mean_out_degree"),
            F.avg("all_in_degree").alias("mean_in_degree"),
        )
    )


def concentration_with_total(s: Study, member: str = trade.EXPORTER) -> DataFrame:
    """Number of leading countries per source category, and over all as "total".

    Categories and total come from one scan: weights per country and category are
    repeated under "total" and grouped again.
    """
    weights = (
        s.edible_trade()
        .groupBy("year", "habitat_method", member)
        .agg(strict_sum(WEIGHT).alias(WEIGHT))
        .transform(with_total_rows, "habitat_method")
    )
    counts = trade.n_below(
        trade.concentration(weights, ["year", "habitat_method"], member), ["year", "habitat_method"], s.concentration_percent
    )
    return counts.where(F.col("habitat_method") != d.UNKNOWN).select(
        "year", F.col("habitat_method").alias("series"), "n"
    )


def _foreign_by_title(s: Study) -> DataFrame:
    """The four foreign-flow tables stacked under their chart titles, from one scan."""
    flows = supply.foreign_consumption_2019(s)
    source = F.concat_ws(" ", "habitat", "method")
    title = F.initcap(restrict_to(source, d.FOUR_SOURCES))
    return flows.where(title.isNotNull()).select(
        "consumer_iso3c", "source_country_iso3c", TONNES, title.alias("habitat_method")
    )


def consumer_map_totals(s: Study) -> DataFrame:
    """Foreign supply of each consumer country per source category."""
    return _foreign_by_title(s).groupBy("consumer_iso3c", "habitat_method").agg(narm_sum(TONNES).alias(TONNES))


def map_attributes(s: Study) -> DataFrame:
    """Consumer totals with the attributes of the country."""
    return lookup(
        consumer_map_totals(s), s.tables.countries, {"consumer_iso3c": "iso3c"}, {"consumer_region": "owid_region"},
        unique="countries",
    )


def country_centroids(s: Study) -> DataFrame:
    lon, lat = F.col("centroid_lon"), F.col("centroid_lat")
    for iso3, (x, y) in s.centroid_overrides.items():
        lon = F.when(F.col("iso3") == iso3, F.lit(x)).otherwise(lon)
        lat = F.when(F.col("iso3") == iso3, F.lit(y)).otherwise(lat)
    return (
        s.tables.centroids.where(F.length("adm1_code") == 3)
        .groupBy("iso3")
        .agg(F.avg("centroid_lon").alias("centroid_lon"), F.avg("centroid_lat").alias("centroid_lat"))
        .select("iso3", lon.alias("centroid_lon"), lat.alias("centroid_lat"))
    )


def flow_arrows(s: Study, source: str) -> DataFrame:
    """Ten largest foreign flows of a category with the ends' coordinates, nudged
    apart in latitude so that opposite arrows do not overlap."""
    centroids = country_centroids(s)
    flows = top_k(supply.foreign_flow(s, source), [], TONNES, 10)
    flows = lookup(
        flows, centroids, {"source_country_iso3c": "iso3"}, {"source_lon": "centroid_lon", "source_lat": "centroid_lat"}
    )
    flows = lookup(
        flows, centroids, {"consumer_iso3c": "iso3"}, {"consumer_lon": "centroid_lon", "consumer_lat": "centroid_lat"}
    )
    return flows.withColumns(
        {"source_lat": F.lit(1.05) * F.col("source_lat"), "consumer_lat": F.lit(0.95) * F.col("consumer_lat")}
    )


def sciname_totals(s: Study) -> DataFrame:
    """Weight of the leading species per flow end and category."""
    flows = supply.top_scinames_source_consumer(s)
    title = F.initcap(restrict_to("habitat_method", d.FOUR_SOURCES))
    return (
        flows.withColumn("habitat_method", title)
        .where(F.col("habitat_method").isNotNull())
        .groupBy("common_name", "flow", "habitat_method")
        .agg(narm_sum(TONNES).alias(TONNES))
    )


def axis_limits(s: Study) -> DataFrame:
    """Largest values of maps, arrows and bars in million tonnes, from one pass over consumption."""
    if s.consumption_cube is None:
        s = s.with_shared_consumption(in_plan)
    largest = millions(F.max(TONNES)).alias("max_value")
    return stack_tagged(
        {
            "map": consumer_map_totals(s).agg(largest),
            "arrows": _foreign_by_title(s).agg(largest),
            "stacked_bar": sciname_totals(s).agg(largest),
        },
        "axis",
    ).select("axis", "max_value")


def clean_common_names(s: Study) -> DataFrame:
    """Leading species with the names shown on the chart of their category. One chart
    also shortens the regions."""
    flows = supply.top_scinames_source_consumer(s).where(F.col("habitat_method").isin(*d.FOUR_SOURCES))
    label = F.lit(None).cast("string")
    for source, labels in d.SPECIES_LABELS.items():
        shown = chart_name("common_name", labels, source in d.DROP_NEI_SOURCES)
        label = F.when(F.col("habitat_method") == source, shown).otherwise(label)
    short = F.when(F.col("habitat_method") == "inland aquaculture", abbreviate_region("region", dot=". "))
    return flows.withColumns({"label": label, "region_label": short.otherwise(F.col("region"))})


def _flow_ends(s: Study) -> DataFrame:
    """Every regional flow once under its exporter and once under its importer."""
    flows = trade.region_method_flows(s).drop("exporter_importer")
    return long_split(flows, ["exporter_region", "importer_region"], ["flow", "drop"], "region", "_")


def region_net_import(s: Study) -> DataFrame:
    """Imports less exports of each region that imports.

    Both sides come from one aggregate over the ends of the flows, not from a join.
    """
    imports = F.when(F.col("flow") == "importer", F.col(WEIGHT))
    exports = F.when(F.col("flow") == "exporter", F.col(WEIGHT))
    return (
        _flow_ends(s)
        .groupBy("year", "region")
        .agg(F.sum(imports).alias("import_live_weight_t"), F.sum(exports).alias("export_live_weight_t"))
        .where(F.col("import_live_weight_t").isNotNull())
        .withColumn("net_import", F.col("import_live_weight_t") - F.col("export_live_weight_t"))
    )


def region_flow_totals(s: Study) -> DataFrame:
    """Exports (negative) and imports of each region per source category."""
    signed = F.when(F.col("flow") == "exporter", -F.col(WEIGHT)).otherwise(F.col(WEIGHT))
    return _flow_ends(s).groupBy("flow", "year", "region", "habitat_method").agg(narm_sum(signed).alias(WEIGHT))


def abbreviated_regions(s: Study) -> DataFrame:
    return trade.regional_trade(s).withColumns(
        {c: abbreviate_region(c) for c in ("exporter_region", "importer_region")}
    )


def sankey_regions(s: Study, source: str) -> DataFrame:
    """Flow diagram of one source category between regions."""
    habitat, method = source.split(" ")
    flows = (
        abbreviated_regions(s)
        .where((F.col("habitat") == habitat) & (F.col("method") == method))
        .groupBy("exporter_region", "importer_region")
        .agg(narm_sum(WEIGHT).alias(WEIGHT))
    )
    links = flow_links(flows, ["exporter_region", "importer_region"], WEIGHT)
    return links.withColumns(
        {
            "node": restrict_to("node", d.FLOW_NODE_ORDER),
            "node_order": level_order("node", d.FLOW_NODE_ORDER),
        }
    )


def top_partners_long(top: DataFrame) -> DataFrame:
    """Domestic and foreign weight of leading countries, one row each."""
    return long(top, ["domestic", "foreign"], "dom_source", "live_weight_t_2")


def ldc_net_with_total(s: Study) -> DataFrame:
    """Net exports of the least-developed group per category and over all."""
    net = trade.ldc_net_habitat_method_summary(s).select("year", "habitat_method", "net_export")
    levels = (*d.FOUR_SOURCES, "total")
    return (
        with_total_rows(net, "habitat_method")
        .groupBy("year", "habitat_method")
        .agg(strict_sum("net_export").alias("net_export"))
        .withColumn("habitat_method", restrict_to("habitat_method", levels))
        .withColumn("level_order", level_order("habitat_method", levels))
    )


def hs_version_series(s: Study) -> DataFrame:
    """Version series as an ordered category; the custom series is outside it."""
    return trade.trade_ts_union(s).withColumns(
        {
            "level_order": level_order("hs_version", d.HS_VERSIONS),
            "hs_version": restrict_to("hs_version", d.HS_VERSIONS),
        }
    )
