"""Dimensions whose keys must not repeat, and names that must find their codes."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tests.test_plans import fact_scans
from tradeweave.functions import domains as d
from tradeweave.operators import joins
from tradeweave.plans import supply, trade
from tradeweave.sources.tables import country_names

# Where two branches of a plan fail at once, Spark throws both in one
FAILURE = (PySparkException, Py4JJavaError)


def test_a_repeated_key_is_an_error_that_names_it(spark):
    facts = spark.createDataFrame([("A", 1), ("B", 2), ("Z", 3), (None, 4)], "iso3c string, v int")
    places = spark.createDataFrame([("A", "x"), ("B", "y"), ("B", "z")], "iso3c string, region string")
    take = ({"iso3c": "iso3c"}, {"region": "region"})
    assert joins.lookup(facts, places, *take).count() == 5
    with pytest.raises(FAILURE, match="countries: iso3c=B occurs 2 times"):
        joins.lookup(facts, places, *take, unique="countries").collect()
    once = places.where("region <> 'z'").union(spark.createDataFrame([(None, "n"), (None, "m")], places.schema))
    out = joins.lookup(facts, once, *take, unique="countries")
    assert sorted(out.collect(), key=str) == [("A", 1, "x"), ("B", 2, "y"), ("Z", 3, None), (None, 4, None)]


def test_keys_that_match_when_missing_may_not_repeat_when_missing(spark):
    facts = spark.createDataFrame([(None, 2001)], "k string, year int")
    table = spark.createDataFrame([(None, 2001, 1), (None, 2001, 2)], "k string, year int, v int")
    with pytest.raises(FAILURE, match="t: k=missing, year=2001 occurs 2 times"):
        joins.lookup(facts, table, {"k": "k", "year": "year"}, {"v": "v"}, null_safe=["k"], unique="t").collect()


def test_a_country_or_population_that_repeats_fails_the_datasets(make_study):
    rows = {
        "snet": [dict(record_id=1, year=2013, hs_version="HS12", hs6=30211, exporter_iso3c="A", importer_iso3c="B", habitat="marine", method="capture", dom_source="domestic", live_weight_t=5, product_weight_t=5)],
        "consumption": [dict(record_id=1, year=2013, hs_version="HS12", consumer_iso3c="A", source_country_iso3c="A", habitat="marine", method="capture", consumption_source="domestic", consumption_live_t=5)],
        "countries": [dict(record_id=i, iso3c=c, owid_region=r) for i, (c, r) in enumerate([("A", "Asia"), ("B", "Europe")])],
        "population": [dict(record_id=1, iso3c="A", year=2013, pop=10)],
    }
    from decimal import Decimal

    for name in ("snet", "consumption"):
        rows[name] = [{k: Decimal(v) if k.endswith("_t") else v for k, v in r.items()} for r in rows[name]]
    s = make_study(**rows)
    assert trade.region_flows(s).count() == 1 and supply.supply(s).count() == 1
    twice = make_study(**{**rows, "countries": rows["countries"] + [dict(record_id=9, iso3c="A", owid_region="Africa")]})
    for dataset in (trade.region_flows, trade.bilateral_habitat_method_summary, supply.supply, supply.regional_pop):
        with pytest.raises(FAILURE, match="countries: iso3c=A occurs 2 times"):
            dataset(twice).collect()
    people = make_study(**{**rows, "population": rows["population"] * 2})
    for dataset in (supply.supply, supply.consumption_outliers):
        with pytest.raises(FAILURE, match="population: iso3c=A, year=2013 occurs 2 times"):
            dataset(people).collect()


@pytest.mark.parametrize("dataset", [trade.region_flows, trade.regional_trade, trade.bilateral_flow_change, supply.supply])
def test_the_test_of_keys_reads_no_fact(study, dataset):
    assert fact_scans(dataset(study)) == 1


def test_building_a_lookup_runs_no_job(spark, study):
    spark.sparkContext.setJobGroup("contract", "")
    trade.bilateral_habitat_method_summary(study)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("contract")
    spark.sparkContext.setJobGroup("tests", "")


def _codes(spark, names, **options):
    codes, aliases = country_names(spark)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, country string")
    out = joins.code_for_name(df, "country", codes, aliases=aliases, **options)
    return [r["iso3c"] for r in out.orderBy("i").collect()]


def test_every_listed_name_has_its_code(spark):
    assert _codes(spark, d.LDC_CODE_BY_NAME) == list(d.LDC_CODES) and len(set(d.LDC_CODES)) == 46
    assert _codes(spark, d.COUNTRY_ALIASES) == list(d.COUNTRY_ALIASES.values())


def test_case_accents_and_punctuation_do_not_matter(spark):
    names = ["SENEGAL", "sénégal", " Timor  Leste ", "GUINEA_BISSAU", "Sao Tomé & Principe", "lao people`s dem republic", "Congo (Dem. Rep.)"]
    assert _codes(spark, names) == ["SEN", "SEN", "TLS", "GNB", "STP", None, "COD"]
    assert _codes(spark, ["Nigeria", "Nig er", "", " ", None, "Guinea Ecuatorial", "Congo", "-"]) == [None] * 8


def test_a_spelling_of_two_countries_is_an_error(spark):
    codes = spark.createDataFrame([("Congo", "COD"), ("CONGO.", "COG"), ("Chad", "TCD"), ("chad", "TCD")], "name string, iso3c string")
    df = spark.createDataFrame([("Chad",), ("Congo",)], "country string")
    assert joins.code_for_name(df.limit(1), "country", codes.where("name not like 'C%.'")).collect() == [("Chad", "TCD")]
    with pytest.raises(FAILURE, match="(?i)country names: _name=congo occurs 2 times"):
        joins.code_for_name(df, "country", codes).collect()


def test_names_are_joined_not_looped(spark):
    codes, aliases = country_names(spark)
    df = spark.range(10).select(F.col("id").cast("string").alias("country"))
    plan = plan_of(joins.code_for_name(df, "country", codes, aliases=aliases))
    assert "Join" in plan and "Python" not in plan


def test_key_report_counts_repeats_and_missing_keys(spark):
    t = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), (None, 1), ("B", None)], "k string, y int")
    assert joins.key_report(t, ["k", "y"], "t").collect() == [("t", 5, 2, 1, 2)]
    assert joins.key_report(t.limit(0), ["k"], "none").collect() == [("none", 0, 0, 0, 0)]
