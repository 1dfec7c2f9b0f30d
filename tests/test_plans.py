"""Physical plans: what must never appear, and what must."""

import os

import pytest

from checks import registry
from tests.conftest import SMALL, optimized, plan_of
from tradeweave.operators import windows
from tradeweave.plans import headline, lastmile, pipeline, supply, trade
from tradeweave.sources import sinks

# Base tables that the fixture reads.
FIXTURE_TABLES = 7
# Anything that moves rows through Python, one task or the driver.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(pipeline.DATASETS))
def test_no_cross_join_and_no_python(study, name):
    plan = plan_of(pipeline.DATASETS[name](study))
    assert not [word for word in FORBIDDEN if word in plan]


def test_operators_have_no_cross_join_and_no_python(study):
    from checks.operators import OPERATORS

    for name, f in OPERATORS.items():
        plan = plan_of(f(study))
        assert not [word for word in FORBIDDEN if word in plan], name


def test_countries_are_broadcast(study):
    plan = plan_of(trade.region_method_flows(study))
    assert "BroadcastHashJoin [exporter_iso3c" in plan and "BroadcastHashJoin [importer_iso3c" in plan


def test_rows_below_top_k_are_dropped_before_the_shuffle(study):
    for by in (["habitat_method"], []):
        flows = trade.export_by_source(study).withColumnRenamed("live_weight_t", "w")
        assert plan_of(windows.top_k(flows, by, "w", 3)).count("WindowGroupLimit") == 2


def test_outliers_are_joined_without_a_hint(study):
    for dataset in (supply.consumption_percap_adjusted, supply.consumption_scaled):
        assert "strategy=" not in optimized(dataset(study))


def fact_scans(df) -> int:
    return sum("FileScan" in line and "l_orderkey" in line for line in plan_of(df).splitlines())


def test_concentration_reads_trade_once(study):
    assert fact_scans(headline.concentration_lookups(study)) == 1


def test_export_share_lookups_read_what_one_series_reads(study):
    assert fact_scans(headline.percent_export_lookups(study)) == fact_scans(trade.percent_export_total(study))


@pytest.mark.parametrize("name", ["growth_statements", "axis_limits", "global_max", "consumption_scaled"])
def test_building_a_query_runs_no_job_and_writes_nothing(spark, name):
    spark.sparkContext.setJobGroup(f"build-{name}", "")
    before = set(os.listdir(sinks.shared_dir(spark).removeprefix("file:")))
    registry.queries()[name](spark, SMALL)
    written = set(os.listdir(sinks.shared_dir(spark).removeprefix("file:"))) - before
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}")
    spark.sparkContext.setJobGroup("tests", "")
    assert not written
    # reading a Parquet folder takes a job each for its schema
    assert len(jobs) <= FIXTURE_TABLES


def test_supply_reads_consumption_once(study):
    scans = [line for line in plan_of(supply.supply(study)).splitlines() if "FileScan" in line and "l_orderkey" in line]
    assert len(scans) == 1


@pytest.mark.parametrize(
    "dataset",
    [
        trade.all_degree_summary,
        trade.trade_ts_union,
        trade.bilateral_habitat_method_summary,
        lastmile.region_net_import,
        lastmile.concentration_with_total,
        headline.dom_source_shares,
    ],
)
def test_trade_is_read_once(study, dataset):
    scans = [line for line in plan_of(dataset(study)).splitlines() if "FileScan" in line and "l_orderkey" in line]
    assert len(scans) == 1


def test_unused_columns_are_not_read(study):
    scan = next(line for line in plan_of(trade.dom_source_ts(study)).splitlines() if "l_orderkey" in line and "FileScan" in line)
    assert "l_returnflag" not in scan and "l_linestatus" not in scan


def test_detail_rows_never_meet_in_one_partition(study):
    """Single-partition exchanges only ever carry aggregated rows."""
    # what a yearly table of a few rows is sorted, ranked or totalled by
    small = {"regional_avg_annual_change", "bilateral_flow_change"}
    for name, dataset in pipeline.DATASETS.items():
        plan = plan_of(dataset(study)).split("Subquery")[0]
        for i, line in enumerate(plan.splitlines()):
            if "Exchange SinglePartition" in line and name not in small:
                # below it only sums over groups, or rows that were pruned per task
                below = "\n".join(plan.splitlines()[i:])
                assert "Aggregate" in below.split("FileScan")[0], name


def test_every_registered_query_has_sql():
    from checks import oracle

    assert registry.queries().keys() == oracle.SQL.keys()
