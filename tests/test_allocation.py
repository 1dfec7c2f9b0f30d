from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradeweave.operators import allocation as cap
from tradeweave.plans import supply
from tradeweave.plans.study import combine_parts


def consumption(*rows):
    names = ("consumer_iso3c", "year", "habitat", "method", "consumption_source", "consumption_live_t")
    out = []
    for i, r in enumerate(rows):
        row = dict(zip(names, r)) | {"hs_version": "HS96", "record_id": i, "sciname_hs_modified": "cod"}
        row["source_country_iso3c"] = row["consumer_iso3c"]
        if row["consumption_live_t"] is not None:
            row["consumption_live_t"] = Decimal(row["consumption_live_t"])
        out.append(row)
    return out


COUNTRIES = [{"iso3c": "AAA", "owid_region": "Asia"}, {"iso3c": "BBB", "owid_region": "Europe"}]
PEOPLE = [
    {"iso3c": "AAA", "year": 1996, "pop": 1000},
    {"iso3c": "BBB", "year": 1996, "pop": 1000},
    {"iso3c": "BBB", "year": 1997, "pop": 0},
]


def study_of(make_study, *rows):
    return make_study(consumption=consumption(*rows), countries=COUNTRIES, population=PEOPLE)


def test_outliers_are_cut_to_the_cap_in_proportion(make_study):
    s = study_of(
        make_study,
        ("AAA", 1996, "marine", "capture", "domestic", "150.00"),
        ("AAA", 1996, "inland", "capture", "foreign", "50.00"),
        ("BBB", 1996, "marine", "capture", "domestic", "100.00"),
    )
    assert [tuple(r) for r in supply.consumption_outliers(s).collect()] == [("AAA", 1996, Decimal("100.000000"))]
    out = {(r.consumer_iso3c, r.habitat): float(r.consumption_live_t) for r in supply.consumption_percap_adjusted(s).collect()}
    assert out == {("AAA", "marine"): 75.0, ("AAA", "inland"): 25.0, ("BBB", "marine"): 100.0}


def test_missing_population_or_weight_means_no_correction(make_study):
    s = study_of(
        make_study,
        ("AAA", 1998, "marine", "capture", "domestic", "900.00"),
        ("BBB", 1996, "marine", "capture", "domestic", "900.00"),
        ("BBB", 1996, "marine", "capture", "domestic", None),
    )
    assert supply.consumption_outliers(s).count() == 0
    total = supply.supply(s).agg(F.sum("supply")).first()[0]
    assert float(total) == 1800.0


def test_no_people_but_supply_is_an_outlier(make_study):
    s = study_of(make_study, ("BBB", 1997, "marine", "capture", "domestic", "5.00"))
    assert [r.corrected_consumption_t for r in supply.consumption_outliers(s).collect()] == [Decimal("0.000000")]


def test_detail_and_sums_are_corrected_alike(study):
    """Correcting rows then adding equals adding then correcting, to the last digit."""
    keys = ["iso3c", "habitat", "method", "year"]
    detail = supply.consumption_percap_adjusted(study).groupBy(
        F.col("consumer_iso3c").alias("iso3c"), "habitat", "method", "year"
    ).agg(F.sum("consumption_live_t").alias("supply"))
    whole = supply.supply(study).select(*keys, "supply")
    assert detail.select(*keys, "supply").exceptAll(whole).count() == 0
    assert detail.count() == whole.count()


def test_supply_per_head_stays_within_the_cap(study):
    factors = cap.outliers(study.consumption(), study.tables.population).select(*cap.KEYS, "factor")
    parts = combine_parts(study.consumption(), cap.KEYS)
    weight = parts.schema["consumption_live_t"].dataType
    adjusted = (
        parts.join(factors, list(cap.KEYS), "left")
        .withColumn("t", cap.scaled(F.col("consumption_live_t"), F.col("factor"), weight).cast("double"))
        .join(study.tables.population.withColumnRenamed("iso3c", "consumer_iso3c"), list(cap.KEYS))
    )
    highest = adjusted.select(F.max(F.col("t") * 1000 / F.col("pop"))).first()[0]
    assert highest == pytest.approx(100, rel=1e-9)


def test_two_step_form_agrees_with_one_step(study):
    columns = ["consumer_year", "sciname_hs_modified", "habitat", "method", "consumption_live_t"]
    stacked = supply.adjusted_by_union(study)
    known = stacked.join(
        supply.consumption_percap_adjusted(study).select("consumer_year").distinct(), "consumer_year", "left_semi"
    )
    one_step = supply.consumption_percap_adjusted(study).select(*columns)
    assert one_step.exceptAll(known.select(*columns)).count() == 0


def test_double_weights_are_scaled_in_double(spark):
    parts = spark.createDataFrame([("AAA", 1996, 200.0, 0)], "consumer_iso3c string, year int, consumption_live_t double, n_missing int")
    people = spark.createDataFrame([("AAA", 1996, 1000)], "iso3c string, year int, pop long")
    out = cap.outliers(parts, people).first()
    assert out.factor == 0.5 and isinstance(out.factor, float)
