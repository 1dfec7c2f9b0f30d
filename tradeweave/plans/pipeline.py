"""All datasets by name, and a run that writes them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tradeweave.functions.domains import FOUR_SOURCES
from tradeweave.plans import headline, lastmile, study, supply, trade
from tradeweave.plans.study import Study
from tradeweave.sources import schemas
from tradeweave.sources.sinks import (
    SharedTables,
    delete,
    input_state,
    read_text,
    shared_dir,
    write_csv,
    write_parquet,
    write_text,
    write_years,
)

Dataset = Callable[[Study], DataFrame]


def _key(source: str) -> str:
    return source.replace(" ", "_")


def _production(s: Study) -> DataFrame:
    return s.tables.production.drop("record_id")


TRADE: dict[str, Dataset] = {
    "prod": _production,
    "trade_nonfood": study.nonfood_trade,
    "trade_fm": trade.fishmeal_trade,
    "prod_summary": trade.prod_summary,
    "global_export_by_source": trade.global_export_by_source,
    "fig_1a": trade.export_by_source,
    "prod_by_source": trade.prod_by_source,
    "dom_export_by_source": trade.dom_export_by_source,
    "percent_export_by_source": trade.percent_export_by_source,
    "percent_export_total": trade.percent_export_total,
    "all_degree_summary": trade.all_degree_summary,
    "habitat_method_degree_summary": trade.habitat_method_degree_summary,
    "degree_levels": trade.degree_levels,
    "bilateral_habitat_method_summary": trade.bilateral_habitat_method_summary,
    "export_concentration_habitat_method": trade.export_concentration,
    "export_concentration_n_countries": trade.export_concentration_n_countries,
    "export_concentration_hm_n_countries": trade.export_concentration_n_countries_by_source,
    "import_concentration_habitat_method": trade.import_concentration,
    "import_concentration_n_countries": trade.import_concentration_n_countries,
    "import_concentration_hm_n_countries": trade.import_concentration_n_countries_by_source,
    "trade_region_method": trade.region_method_flows,
    "regional_trade": trade.regional_trade,
    "bilateral_flow_change": trade.bilateral_flow_change,
    "top_exporters_old": trade.top_exporters_old,
    "top_exporters_new": trade.top_exporters_new,
    "top_importers_total_old": trade.top_importers_total_old,
    "top_importers_total_recent": trade.top_importers_total_recent,
    "top_importers_old": trade.top_importers_old,
    "top_importers_new": trade.top_importers_new,
    "trade_region": trade.region_flows,
    "region_slopes": trade.region_slopes,
    "regional_avg_annual_change": trade.regional_avg_annual_change,
    "dom_source_ts": trade.dom_source_ts,
    "dom_source_by_habitat_method": trade.dom_source_by_habitat_method,
    "ldc_habitat_method_summary": trade.ldc_habitat_method_summary,
    "ldc_net_habitat_method_summary": trade.ldc_net_habitat_method_summary,
    "trade_ts_by_version": trade.trade_ts_by_version,
    "custom_ts": trade.custom_ts,
    "trade_ts_union": trade.trade_ts_union,
}

SUPPLY: dict[str, Dataset] = {
    "consumption_outliers": supply.consumption_outliers,
    "consumption_scaled": supply.consumption_scaled,
    "consumption_percap_adjusted": supply.consumption_percap_adjusted,
    "foreign_consumption_2019": supply.foreign_consumption_2019,
    **{f"foreign_flow_{_key(c)}": partial(supply.foreign_flow, source=c) for c in FOUR_SOURCES},
    "top_scinames_foreign_consumed": supply.top_scinames_foreign_consumed,
    "top_scinames_source_consumer": supply.top_scinames_source_consumer,
    **{f"top_scinames_{_key(c)}": partial(supply.top_scinames, source=c) for c in FOUR_SOURCES},
    "supply": supply.supply,
    "global_pop": supply.global_pop,
    "regional_pop": supply.regional_pop,
    "global_supply_per_cap": supply.global_supply_per_cap,
    "supply_total": supply.supply_total,
    "fig4a": supply.supply_per_cap_by_source,
    "fig4b": supply.supply_per_cap_by_region,
    "fig4c": supply.supply_origin_percent,
    "fig4d": supply.regional_supply_origin_percent,
    "global_supply": supply.global_supply,
    "regional_method_supplies": supply.regional_method_supplies,
    "method_supplies": supply.method_supplies,
    "habitat_method_supply": supply.habitat_method_supply,
    "consumption_foreign": supply.consumption_foreign,
}

LASTMILE: dict[str, Dataset] = {
    "mean_degree_by_source": lastmile.mean_degree_by_source,
    "concentration_with_total": lastmile.concentration_with_total,
    "import_concentration_with_total": partial(lastmile.concentration_with_total, member=trade.IMPORTER),
    "consumer_map_totals": lastmile.consumer_map_totals,
    "country_centroids": lastmile.country_centroids,
    **{f"flow_arrows_{_key(c)}": partial(lastmile.flow_arrows, source=c) for c in FOUR_SOURCES},
    "axis_limits": lastmile.axis_limits,
    "sciname_totals": lastmile.sciname_totals,
    "clean_common_names": lastmile.clean_common_names,
    "abbreviate_regions": lastmile.abbreviated_regions,
    "region_net_import": lastmile.region_net_import,
    "region_flow_totals": lastmile.region_flow_totals,
    **{f"sankey_regions_{_key(c)}": partial(lastmile.sankey_regions, source=c) for c in FOUR_SOURCES},
    "top_partners_long_exporters_old": lambda s: lastmile.top_partners_long(trade.top_exporters_old(s)),
    "top_partners_long_exporters_new": lambda s: lastmile.top_partners_long(trade.top_exporters_new(s)),
    "top_partners_long_importers_old": lambda s: lastmile.top_partners_long(trade.top_importers_old(s)),
    "top_partners_long_importers_new": lambda s: lastmile.top_partners_long(trade.top_importers_new(s)),
    "ldc_net_with_total": lastmile.ldc_net_with_total,
    "hs_version_series": lastmile.hs_version_series,
}

HEADLINE: dict[str, Dataset] = {
    "trade_totals": headline.trade_totals,
    "fishmeal_totals": headline.fishmeal_totals,
    "percent_export_lookups": headline.percent_export_lookups,
    "concentration_lookups": headline.concentration_lookups,
    "mean_out_degree": headline.mean_out_degree,
    "foreign_export_change": headline.foreign_export_change,
    "export_share_by_dom_source": headline.export_share_by_dom_source,
    "percent_flow_increases": headline.percent_flow_increases,
    "global_supply_lookups": headline.global_supply_lookups,
    "regional_supply_trends": headline.regional_supply_trends,
    "regional_hm_supply_trends": headline.regional_hm_supply_trends,
    "hm_supply_trends": headline.hm_supply_trends,
    "habitat_method_supply_change": headline.habitat_method_supply_change,
    "max_supply_share": headline.max_supply_share,
    "region_capture_share": headline.region_capture_share,
    "capture_share": headline.capture_share,
    "foreign_share_start_end": headline.foreign_share_start_end,
    "asia_farmed_overtake_year": headline.asia_farmed_overtake_year,
    "foreign_share_by_region_2019": headline.foreign_share_by_region_2019,
    "growth_statements": headline.growth_statements,
    "supply_statements": headline.supply_statements,
}

DATASETS: dict[str, Dataset] = {**TRADE, **SUPPLY, **LASTMILE, **HEADLINE}

# Datasets that are detail rows: Parquet is laid out by year.
DETAIL = ("prod", "trade_nonfood", "consumption_scaled", "consumption_percap_adjusted")


#: Raised when a dataset changes its meaning: what older code committed is written anew.
VERSION = 1


def state_of(s: Study, inputs: str | None = None) -> str | None:
    """A digest of the settings and of the state of the inputs.

    The inputs' state is told from the files they are read from, or given by the
    caller, as for tables in a database. None if it cannot be told.
    """
    told: list = [VERSION]
    for f in fields(s):
        value = getattr(s, f.name)
        if f.name == "tables":
            tables = [getattr(value, name) for name in schemas.TABLES]
        elif isinstance(value, DataFrame):
            tables = [value]
        else:
            told.append((f.name, repr(value)))
            continue
        states = [inputs] if inputs is not None else [input_state(t) for t in tables]
        if None in states:
            return None
        told.append((f.name, states))
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


class Manifest:
    """What a run has committed under ``out``: a small file per dataset, each with the
    state of what it was computed from. A dataset without one is not finished."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.folder = spark, f"{out}/_committed"

    def read(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self.folder}/{name}.json")
        return json.loads(text) if text else None

    def commit(self, name: str, **entry) -> None:
        write_text(self.spark, f"{self.folder}/{name}.json", json.dumps(entry, sort_keys=True))

    def revoke(self, name: str) -> None:
        delete(self.spark, f"{self.folder}/{name}.json")


def run(
    s: Study,
    out: str,
    names: Iterable[str] | None = None,
    csv: bool = False,
    at_once: int = 8,
    inputs: str | None = None,
) -> dict[str, str]:
    """Write datasets under ``out``; returns the path of each.

    Each large fact is read once and the grains that datasets start from are written;
    then supply and the network's edges, which many start from; all others read those.
    As most are small, several are computed at once. Parquet by default, CSV with
    ``csv``.

    A dataset is committed when it is written. A run that was cut off and is started
    again over the same inputs and settings writes only what is not committed, also
    where only the process ended: shared tables that were complete are read again.
    Over changed inputs all is computed, and of datasets laid out by year the years
    that came out different are replaced. ``inputs`` names the state of inputs that
    are not files; without it such a run starts over.
    """
    spark = s.tables.snet.sparkSession
    manifest, kind = Manifest(spark, out), "csv" if csv else "parquet"
    state = state_of(s, inputs)
    chosen = list(DATASETS if names is None else names)
    entries = {name: manifest.read(name) for name in chosen}
    paths = {name: f"{out}/{name}" for name in chosen}

    def finished(entry: dict | None) -> bool:
        return state is not None and entry is not None and (entry["state"], entry["kind"]) == (state, kind)

    todo = [name for name in chosen if not finished(entries[name])]
    if not todo:
        return paths
    folder = f"{shared_dir(spark)}/run-{hashlib.sha256(out.encode()).hexdigest()[:24]}"
    marker = f"{folder}/_state"
    if state is None or read_text(spark, marker) != state:
        delete(spark, folder)  # what a run over other inputs left behind
    shared_tables = SharedTables(spark, folder)
    try:
        write_text(spark, marker, state or "")
        shared = s.shared(shared_tables.keep).with_shared_edges(shared_tables.keep)
        shared = replace(shared, supply_table=shared_tables.keep(supply.supply(shared), "supply"))

        def write(name: str) -> None:
            before, years = entries[name], None
            # what is there counts as unfinished while it is replaced
            manifest.revoke(name)
            if csv:
                write_csv(DATASETS[name](shared), paths[name])
            elif name in DETAIL:
                if not before or before["kind"] != kind:
                    delete(spark, paths[name])
                years = write_years(DATASETS[name](shared), paths[name])
            else:
                write_parquet(DATASETS[name](shared), paths[name])
            manifest.commit(name, state=state, kind=kind, years=years)

        with ThreadPoolExecutor(at_once) as pool:
            for _ in pool.map(write, todo):
                pass
    finally:
        shared_tables.drop()
    return paths
