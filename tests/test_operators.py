import pytest
from pyspark.sql import functions as F

from tradeweave.operators import concentration, joins, network, reshape, windows


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


# -- joins -----------------------------------------------------------------------


def test_lookup_matches_missing_only_when_asked(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "key string, w int")
    on, take = {"k": "key"}, {"w": "w"}
    assert as_set(joins.lookup(left, right, on, take), "v", "w") == {(1, 10), (2, None)}
    assert as_set(joins.lookup(left, right, on, take, null_safe=["k"]), "v", "w") == {(1, 10), (2, 20)}


def test_lookup_repeats_rows_for_repeated_keys(spark):
    left = spark.createDataFrame([("cod",)], "s string")
    names = spark.createDataFrame([("cod", "a"), ("cod", "b")], "s string, common_name string")
    assert joins.lookup(left, names, {"s": "s"}, {"common_name": "common_name"}).count() == 2


def test_full_join_merges_keys_including_missing(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "x", 6)], "y int, k string, a int")
    right = spark.createDataFrame([(1, None, 7), (3, "z", 8)], "y int, k string, b int")
    out = joins.full_on(left, right, ["y", "k"])
    assert as_set(out, "y", "k", "a", "b") == {(1, None, 5, 7), (2, "x", 6, None), (3, "z", None, 8)}


def test_anti_join_on_real_columns(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "c string, y int")
    out = joins.without_keys(rows, spark.createDataFrame([("a", 1), (None, 9)], "c string, y int"), ["c", "y"])
    assert as_set(out, "c", "y") == {("a", 2), (None, 1)}


# -- windows ---------------------------------------------------------------------


def test_cumulative_share_goes_row_by_row_on_ties(spark):
    df = spark.createDataFrame([("g", "b", 25.0), ("g", "a", 25.0), ("g", "c", 50.0)], "g string, m string, x double")
    out = windows.cumulative_share(df, ["g"], "x", tie_break="m")
    assert as_set(out, "m", "cumulative_percent") == {("c", 50.0), ("a", 75.0), ("b", 100.0)}


def test_top_k_keeps_ties_and_puts_missing_last(spark):
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate([9.0, 7.0, 7.0, 1.0, None])], "g string, i int, x double")
    assert as_set(windows.top_k(df, ["g"], "x", 2), "i") == {(0,), (1,), (2,)}
    assert as_set(windows.top_k(df, [], "x", 1), "i") == {(0,)}


def test_rank_averages_ties_ascending(spark):
    df = spark.createDataFrame([("g", x) for x in [10.0, 20.0, 20.0, 30.0]], "g string, x double")
    out = df.select("x", windows.average_rank("x", ["g"]).alias("r"))
    assert sorted(tuple(r) for r in out.collect()) == [(10.0, 1.0), (20.0, 2.5), (20.0, 2.5), (30.0, 4.0)]


def test_group_total_is_missing_if_an_input_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, x double")
    assert as_set(windows.group_total(df, ["g"], "x", "t"), "g", "t") == {("a", None), ("b", 2.0)}
    assert as_set(windows.group_total(df, ["g"], "x", "t", skip_missing=True), "g", "t") == {("a", 1.0), ("b", 2.0)}


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, x double")
    out = windows.share_of_group(df, ["g"], "x", "p")
    assert as_set(out, "g", "p") == {("a", 25.0), ("a", 75.0), ("b", 100.0)}
    whole = windows.share_of_all(df, "x", "p", "t")
    assert sum(r.p for r in whole.collect()) == pytest.approx(100)


def test_rows_at_extremes_keep_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "i int, x double")
    assert as_set(windows.rows_at_max(df, "x"), "i") == {(1,), (2,)}
    assert as_set(windows.rows_at_min(df, "x"), "i") == {(3,)}


# -- network and concentration ---------------------------------------------------


def test_degrees_equal_two_counts_joined(spark):
    rows = [(2000, "A", "B"), (2000, "A", "B"), (2000, "A", "C"), (2000, "B", "B"), (2001, "C", "A")]
    df = spark.createDataFrame(rows, "year int, exporter_iso3c string, importer_iso3c string")
    once = network.degrees(df, ["year"])
    out = network.degree_of(df, ["year"], network.SOURCE, "all_out_degree")
    into = network.degree_of(df, ["year"], network.TARGET, "all_in_degree")
    columns = ("year", "iso3c", "all_out_degree", "all_in_degree")
    assert as_set(once, *columns) == as_set(joins.full_on(out, into, ["year", "iso3c"]), *columns)
    assert (2000, "A", 2, None) in as_set(once, *columns)


def test_group_dominated_by_one_member_has_no_row(spark):
    rows = [(2000, "A", 75.0), (2000, "B", 25.0), (2001, "A", 74.0), (2001, "B", 26.0)]
    df = spark.createDataFrame(rows, "year int, c string, live_weight_t double")
    counts = concentration.n_below(concentration.concentration(df, ["year"], "c"), ["year"])
    assert as_set(counts, "year", "n") == {(2001, 1)}


# -- reshaping -------------------------------------------------------------------


def test_wide_fills_absent_cells_only(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "z", 9.0), ("b", "y", None)], "i string, n string, v double")
    out = reshape.wide(df, ["i"], "n", ["x", "y"], F.sum("v"), fill=0)
    assert as_set(out, "i", "x", "y") == {("a", 1.0, 0.0), ("b", 0.0, 0.0)}
    named = reshape.wide(df, ["i"], "n", ["x"], F.sum("v"), prefix="from_")
    assert named.columns == ["i", "from_x"]


def test_long_is_the_inverse_of_wide(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "i string, x double, y double")
    assert as_set(reshape.long(df, ["x", "y"], "n", "v"), "i", "n", "v") == {("a", "x", 1.0), ("a", "y", 2.0)}


def test_long_splits_names(spark):
    df = spark.createDataFrame([(1, "Asia", "Africa")], "w int, exporter_region string, importer_region string")
    out = reshape.long_split(df, ["exporter_region", "importer_region"], ["flow", "drop"], "region", "_")
    assert as_set(out, "w", "flow", "drop", "region") == {
        (1, "exporter", "region", "Asia"), (1, "importer", "region", "Africa"),
    }


def test_stack_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y",)], "s string")
    assert as_set(reshape.stack(a, b), "i", "s") == {(1, "x"), (None, "y")}
    assert as_set(reshape.stack_tagged({"p": b, "q": b}, "t"), "t", "s") == {("p", "y"), ("q", "y")}


def test_total_rows_count_every_category_once(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "g string, x double")
    out = reshape.with_total_rows(df, "g").groupBy("g").agg(F.sum("x").alias("x"))
    assert as_set(out, "g", "x") == {("a", 1.0), (None, 2.0), ("total", 3.0)}


def test_last_stage_of_a_flow_leads_nowhere(spark):
    df = spark.createDataFrame([("Asia", "Africa", 5.0)], "a string, b string, w double")
    assert as_set(reshape.flow_links(df, ["a", "b"], "w"), "x", "node", "next_x", "next_node", "value") == {
        ("a", "Asia", "b", "Africa", 5.0), ("b", "Africa", None, None, 5.0),
    }


def test_missing_values_do_not_rank_or_shift(spark):
    df = spark.createDataFrame([("a", 10), ("a", None), ("a", 20), ("a", None)], "g string, x int")
    out = df.select("x", windows.average_rank("x", ["g"]).alias("r"))
    assert sorted((r["x"] or 0, r["r"]) for r in out.collect() if r["x"]) == [(10, 1.0), (20, 2.0)]
    assert [r["r"] for r in out.collect() if r["x"] is None] == [None, None]


def test_a_missing_weight_leaves_its_group_without_percents(spark):
    df = spark.createDataFrame([("a", "p", 2.0), ("a", "q", None), ("b", "p", 1.0)], "g string, m string, x double")
    out = windows.cumulative_share(df, ["g"], "x", tie_break="m")
    assert {(r["g"], r["cumulative_percent"]) for r in out.collect()} == {("a", None), ("b", 100.0)}
