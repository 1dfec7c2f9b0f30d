"""Properties that hold whatever the data."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from tradeweave.plans import headline, lastmile, supply, trade


def test_every_edge_has_two_ends(study):
    out = trade.all_degree_summary(study).groupBy("year").agg(F.sum("all_out_degree").alias("o"), F.sum("all_in_degree").alias("i"))
    assert out.where("o <> i").count() == 0


def test_running_share_ends_at_hundred(study):
    out = trade.export_concentration(study).groupBy("year", "habitat_method").agg(F.max("cumulative_percent").alias("p"))
    assert out.where("abs(p - 100) > 1e-9").count() == 0


def test_region_net_imports_cancel(spark):
    """In years where every region both buys and sells."""
    net = lastmile.region_net_import(fixtures.study(spark, "/root/testdata/sf0.01")).groupBy("year").agg(
        F.sum("net_import").alias("n"), F.count("net_import").alias("regions")
    )
    years = net.where("regions = 6").collect()
    assert years and all(r.n == 0 for r in years)


def test_supply_is_domestic_plus_foreign(study):
    assert supply.supply(study).where("supply <> supply_domestic + supply_foreign OR supply <= 0").count() == 0


def test_origin_shares_add_up(study):
    for df, by in ((supply.supply_origin_percent(study), ["year"]), (supply.regional_supply_origin_percent(study), ["region", "year"])):
        assert df.groupBy(*by).agg(F.sum("supply_percent").alias("p")).where("abs(p - 100) > 1e-9").count() == 0


def test_shares_of_groups_add_up(study):
    df = supply.habitat_method_supply(study).groupBy("year").agg(F.sum("percent_supply").alias("p"))
    assert df.where("abs(p - 100) > 1e-9").count() == 0
    assert supply.method_supplies(study).agg(F.sum("percent_supply")).first()[0] == pytest.approx(100)


def test_change_is_end_less_beginning(study):
    assert trade.bilateral_flow_change(study).where("change <> `end` - beginning").count() == 0


def test_domestic_share_is_missing_where_a_category_is_unmatched(study):
    rows = trade.percent_export_total(study).where("calc_type = 'domestic exports' AND percent_export IS NULL")
    assert {r.year for r in rows.collect()} == {2007, 2008, 2009, 2010}


def test_least_developed_net_is_symmetric(study):
    assert trade.ldc_net_habitat_method_summary(study).where("net_import <> -net_export").count() == 0


def test_categories_and_total_agree_with_separate_counts(study):
    both = lastmile.concentration_with_total(study)
    total = trade.export_concentration_n_countries(study)
    assert {tuple(r) for r in both.where("series = 'total'").select("year", "n").collect()} == {tuple(r) for r in total.collect()}


def test_union_of_versions_is_original_plus_custom(study):
    union = trade.trade_ts_union(study)
    separate = trade.trade_ts_by_version(study).unionByName(trade.custom_ts(study))
    assert union.exceptAll(separate).count() == 0 and separate.exceptAll(union).count() == 0


def test_farmed_overtakes_wild_in_some_regions_only(study):
    assert headline.overtake_year(study, "Nowhere").collect()[0].farmed_year is None
    assert len(headline.asia_farmed_overtake_year(study).collect()) == 1


def test_overtake_year_is_the_first_one(make_study):
    from decimal import Decimal

    rows = [
        (1996, "capture", "9.00"), (1996, "aquaculture", "1.00"),
        (1997, "capture", "2.00"), (1997, "aquaculture", "3.00"),
        (1998, "capture", "2.00"), (1998, "aquaculture", "4.00"),
    ]
    s = make_study(
        consumption=[
            {"record_id": i, "year": y, "hs_version": "HS96", "consumer_iso3c": "AAA", "source_country_iso3c": "AAA",
             "sciname_hs_modified": "cod", "habitat": "marine", "method": m, "consumption_source": "domestic",
             "consumption_live_t": Decimal(w)}
            for i, (y, m, w) in enumerate(rows)
        ],
        countries=[{"iso3c": "AAA", "owid_region": "Asia"}],
        population=[{"iso3c": "AAA", "year": y, "pop": 1_000_000} for y in (1996, 1997, 1998)],
    )
    assert headline.asia_farmed_overtake_year(s).collect()[0].farmed_year == 1997
