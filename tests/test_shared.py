"""Grains shared by the datasets of a run, and figures read from one pass."""

import pytest
from pyspark.sql import functions as F

from checks.registry import comparable
from tests.conftest import plan_of
from tests.test_plans import fact_scans
from tradeweave.functions import domains as d
from tradeweave.operators import network
from tradeweave.plans import headline, lastmile, pipeline, supply, trade
from tradeweave.sources import sinks


@pytest.fixture(scope="module")
def shared(spark, study):
    folder = sinks.SharedTables(spark, f"{sinks.shared_dir(spark)}/tests-shared")
    yield study.shared(folder.keep).with_shared_edges(folder.keep)
    folder.drop()


@pytest.mark.parametrize("name", sorted(pipeline.DATASETS))
def test_only_detail_rows_are_read_from_a_fact(shared, name):
    assert bool(fact_scans(pipeline.DATASETS[name](shared))) == (name in pipeline.DETAIL)


def test_each_fact_is_read_once_for_all_grains(study):
    from tradeweave.plans import study as s

    for grains in (s.trade_grains, s.production_grains, s.consumption_grains):
        assert fact_scans(grains(study)) == 1


def test_shared_tables_are_bounded_by_the_domains(shared):
    """Species occur in one year's slice only, other rows are no groups of their own."""
    assert "sciname_hs_modified" not in shared.consumption_cube.columns
    assert [r["year"] for r in shared.species_cube.select("year").distinct().collect()] == [2019]
    for cube in (shared.trade_cube, shared.species_cube):
        keys = [c for c in cube.columns if c not in ("live_weight_t", "consumption_live_t", "n_missing")]
        assert cube.groupBy(*keys).count().where("count > 1").count() == 0


def final_scans(df) -> int:
    """Scans of a fact that ran, reused ones not counted."""
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    return sum("FileScan" in line and "l_orderkey" in line for line in plan.splitlines())


def test_statements_read_trade_and_production_once(study):
    assert final_scans(headline.growth_statements(study)) == 2


def test_axis_limits_read_consumption_once(study):
    assert final_scans(lastmile.axis_limits(study)) == 1


def rows(df):
    return sorted(map(repr, comparable(df.select(*sorted(df.columns))).collect()))


def test_degrees_from_edge_sets_equal_distinct_edges(spark):
    trades = [
        (1, "A", "B", "marine capture"), (1, "A", "B", "marine capture"), (1, "A", "B", "unknown"), (1, "A", "B", None),
        (1, "B", "A", "other"), (1, "B", "A", "another"), (1, "C", None, "inland capture"), (2, "A", "A", None),
    ]
    df = spark.createDataFrame(trades, "year int, exporter_iso3c string, importer_iso3c string, habitat_method string")
    sets = network.edge_sets(df, ["year"], "habitat_method", d.HABITAT_METHODS)
    assert sets.count() == 4
    both = network.degrees_from_sets(sets, ["year"], "habitat_method", d.HABITAT_METHODS)
    whole = network.degrees(df, ["year"])
    within = network.degrees(df, ["year", "habitat_method"])
    assert rows(both.where("level = 'all'").drop("level", "habitat_method")) == rows(whole)
    assert rows(both.where("level = 'within'").drop("level")) == rows(within)
    for which, want in (("all", whole), ("within", within)):
        assert rows(network.degrees_from_sets(sets, ["year"], "habitat_method", d.HABITAT_METHODS, which)) == rows(want)


def test_both_degrees_come_from_one_exchange_of_edges(study):
    plan = plan_of(trade.degree_levels(study))
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning(year" in line]
    assert len([k for k in keys if "exporter_iso3c" in k]) == 1 and len(keys) == 2
    assert fact_scans(trade.degree_levels(study)) == 1


def test_settings_reach_the_datasets(study):
    from dataclasses import replace

    half = replace(study, concentration_percent=50)
    more, fewer = (trade.export_concentration_n_countries(s).agg(F.sum("n")).first()[0] for s in (study, half))
    assert fewer < more
    tight = replace(study, max_kg_per_capita=1)
    assert supply.consumption_outliers(tight).count() > supply.consumption_outliers(study).count()
    earlier = replace(study, slice_year=2010)
    assert rows(supply.foreign_consumption_2019(earlier)) != rows(supply.foreign_consumption_2019(study))
    assert rows(supply.foreign_consumption_2019(earlier.with_shared_consumption())) == rows(supply.foreign_consumption_2019(earlier))
