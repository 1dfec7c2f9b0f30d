"""Spark results against the same query in DuckDB on the smallest data.

A selection of every family; ``python -m checks.compare`` runs all of them. Set
ALL_QUERIES=1 to run all here.
"""

import os

import pytest

from checks import compare, registry
from tests.conftest import SMALL

SOME = (
    "scan_trade_regime",
    "normalize_hs6",
    "split_food",
    "habitat_method",
    "factor_relevel",
    "write_csv",
    "degree_full_join",
    "join_ldc_flows",
    "country_to_code",
    "dimension_contract",
    "degree_levels",
    "scan_trade_laid_out",
    "custom_regime_exports",
    "read_csv_rejected",
    "row_counts",
    "ols_slope_by_group",
    "average_rank",
    "top_k_global",
    "order_within_group",
    "pivot_longer_names_sep",
    "signif_digits",
    "percent_export_total",
    "all_degree_summary",
    "bilateral_habitat_method_summary",
    "export_concentration_n_countries",
    "bilateral_flow_change",
    "top_exporters_old",
    "regional_avg_annual_change",
    "ldc_net_habitat_method_summary",
    "trade_ts_union",
    "consumption_percap_adjusted",
    "top_scinames_source_consumer",
    "top_scinames_inland_capture",
    "supply",
    "fig4a",
    "fig4d",
    "regional_method_supplies",
    "flow_arrows_inland_capture",
    "axis_limits",
    "sankey_regions_marine_capture",
    "regional_supply_trends",
    "growth_statements",
    "supply_statements",
    "list_tables",
)


@pytest.fixture(scope="module")
def database():
    return compare.database(SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries()) if os.environ.get("ALL_QUERIES") else SOME)
def test_same_as_sql(spark, database, name):
    assert compare.difference(spark, database, SMALL, name) is None


def test_comparison_notices_a_difference(spark, database, monkeypatch):
    from checks import oracle

    monkeypatch.setitem(oracle.SQL, "fig_1a", oracle.SQL["fig_1a"] + " WHERE year > 1996")
    assert "differing" in compare.difference(spark, database, SMALL, "fig_1a")


def test_entry_points(spark):
    import __spark_entry__ as contract

    assert contract.queries().keys() >= contract.oracle_sql().keys()
    assert registry.queries().keys() <= contract.oracle_sql().keys()
    result = contract.entry(spark)
    assert result.columns == ["year", "n"] and result.count() == 25
