from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradeweave.functions import columns as c
from tradeweave.functions import domains as d
from tradeweave.functions.aggregates import narm_sum, strict_sum, year_slope
from tradeweave.operators.joins import code_for_name


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def texts(spark, *items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i")


def numbers(spark, *items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x double").orderBy("i")


def test_complement_keeps_missing(spark):
    df = texts(spark, "a", "b", None)
    assert values(df.where(c.not_in("x", ["a"])), "x") == ["b", None]


def test_inequality_drops_missing(spark):
    df = texts(spark, "Asia", "Other nei", None)
    assert values(df.where(c.is_known_region("x")), "x") == ["Asia"]


def test_category_folds_unknown_and_restricts(spark):
    rows = [("marine", "capture"), ("marine", "unknown"), (None, "unknown"), (None, "capture"), ("lake", "capture")]
    df = spark.createDataFrame(rows, "h string, m string")
    assert values(df, c.habitat_method("h", "m")) == ["marine capture", "unknown", "unknown", None, None]
    assert values(df, c.habitat_method("h", "m", fold_unknown=False)) == ["marine capture", None, None, None, None]
    assert values(df, c.habitat_method_text("h", "m"))[3] == "NA capture"


def test_code_is_padded_at_five_characters_only(spark):
    df = texts(spark, "30110", "230120", "111", "1234567", None)
    assert values(df, c.hs6_text("x")) == ["030110", "230120", "111", "1234567", None]


def test_fishmeal_flag_keeps_missing(spark):
    df = texts(spark, "230120", "030211", None)
    assert values(df, c.food_or_fmfo(F.col("x") == d.FISHMEAL_CODE)) == ["fishmeal", "nonfishmeal", None]


def test_level_order_and_restriction(spark):
    df = texts(spark, "HS96", "HS17", "Custom time series", None)
    assert values(df, c.level_order("x", d.HS_VERSIONS)) == [1, 5, None, None]
    assert values(df, c.restrict_to("x", d.HS_VERSIONS)) == ["HS96", "HS17", None, None]


def test_regimes_and_open_start(spark):
    rows = [("HS96", 1995), ("HS96", 1996), ("HS96", 2004), ("HS02", 2004), ("HS12", 2020), ("HS17", 2020), ("HS12", 2021)]
    df = spark.createDataFrame(rows, "v string, y int")
    assert df.where(c.in_regime("v", "y")).count() == 3
    assert df.where(c.in_regime("v", "y", open_start=True)).count() == 4


def test_year_groups(spark):
    df = spark.createDataFrame([(y,) for y in (1995, 1996, 2000, 2001, 2016, 2020, 2021)], "y int")
    assert values(df, c.year_group("y")) == [None, "beginning", "beginning", None, "end", "end", None]
    assert df.where(c.in_year_groups("y")).count() == 4


def test_group_membership_of_missing_country(spark):
    df = texts(spark, "AFG", "USA", None)
    assert values(df, c.ldc_flag("x")) == ["LDC", "non-LDC", "non-LDC"]
    assert len(d.LDC_CODES) == len(set(d.LDC_CODES)) == 46


def test_scope_uses_published_spelling(spark):
    df = spark.createDataFrame([("Asia", "Asia"), ("Asia", "Africa"), (None, "Asia")], "a string, b string")
    assert values(df, c.trade_scope("a", "b")) == ["intraregional trade", "interegional trade", None]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert values(df, c.percent("a", "b")) == [None, None, 25.0]


def test_percent_change_and_its_base(spark):
    df = spark.createDataFrame([(50.0, 200.0)], "a double, b double")
    assert values(df, c.percent_change("a", "b")) == [300.0]
    assert values(df, c.percent_change("a", "b", base=F.col("b"))) == [75.0]


def test_rounding_ties_go_to_even(spark):
    df = numbers(spark, 0.5, 1.5, 2.5, -0.5, 0.25)
    assert values(df, c.round_even("x")) == [0.0, 2.0, 2.0, -0.0, 0.0]
    assert values(df, c.round_even("x", 1))[4] == 0.2


@pytest.mark.parametrize("x, digits, expected", [(15.63, 3, 15.6), (0.012345, 3, 0.0123), (-1234.0, 2, -1200.0), (0.0, 3, 0.0)])
def test_significant_digits(spark, x, digits, expected):
    assert values(numbers(spark, x), c.signif("x", digits))[0] == pytest.approx(expected, rel=1e-12)


def test_labels(spark):
    df = texts(spark, "North America", "South America", "Asia")
    assert values(df, c.abbreviate_region("x")) == ["N.America", "S.America", "Asia"]
    assert values(df, c.abbreviate_region("x", dot=". "))[0] == "N. America"
    one = spark.createDataFrame([("CHN", "marine capture")], "a string, b string")
    label = c.within_label("a", "b")
    assert values(one, label) == ["CHN___marine capture"]
    assert values(one, c.within_value(label)) == ["CHN"]


def test_chart_names(spark):
    df = texts(spark, "nile perch", "cyprinids nei", "ray-finned fishes", None)
    labels = d.SPECIES_LABELS["inland capture"]
    assert values(df, c.chart_name("x", labels, drop_nei=True)) == [
        "\nnile\nperch", "cyprinids", "ray\nfinned\nfishes", None,
    ]
    assert values(df, c.chart_name("x", {}, drop_nei=False))[1] == "cyprinids\nnei"


def test_strict_and_skipping_sums(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "g string, x double")
    out = {r.g: (r.s, r.n) for r in df.groupBy("g").agg(strict_sum("x").alias("s"), narm_sum("x").alias("n")).collect()}
    assert out == {"a": (None, 1.0), "b": (2.0, 2.0), "c": (None, 0.0)}


def test_slope_matches_builtin_and_is_missing_for_one_year(spark):
    rows = [("a", 1996, 1.0), ("a", 1998, 6.0), ("a", 2001, 7.5), ("b", 2000, 3.0), ("c", 2000, 1.0), ("c", 2001, None)]
    df = spark.createDataFrame(rows, "g string, year int, y double")
    out = df.groupBy("g").agg(year_slope("y").alias("s"), F.regr_slope("y", "year").alias("builtin")).collect()
    slopes = {r.g: (r.s, r.builtin) for r in out}
    assert slopes["a"][0] == pytest.approx(slopes["a"][1])
    assert slopes["b"][0] is None and slopes["c"][0] is None


def test_slope_of_exact_weights_does_not_depend_on_order(spark):
    rows = [(y, Decimal(f"{(y * 7919) % 1000}.37")) for y in range(1996, 2021)]
    one = spark.createDataFrame(rows, "year int, y decimal(18,2)").agg(year_slope("y")).first()[0]
    two = spark.createDataFrame(rows[::-1], "year int, y decimal(18,2)").repartition(5).agg(year_slope("y")).first()[0]
    assert one == two


def test_codes_by_country_name(spark):
    codes = spark.createDataFrame(list(d.LDC_CODE_BY_NAME.items()), "name string, iso3c string")
    df = texts(spark, "Afghanistan", " lao people’s dem. republic ", "Atlantis", None)
    out = {r.x: r.iso3c for r in code_for_name(df, "x", codes).collect()}
    assert list(out.values()).count(None) == 2
    assert out["Afghanistan"] == "AFG" and out[" lao people’s dem. republic "] == "LAO"
