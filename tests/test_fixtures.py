"""The trade tables of the generated star schema: rows by plain SQL, and what their joins shuffle."""

import re

import duckdb
import pytest

from checks import compare, fixtures, registry
from tests.conftest import SMALL, plan_of
from tradeweave.plans import trade
from tradeweave.plans.study import Study
from tradeweave.sources import regimes, schemas
from tradeweave.sources.tables import TradeTables

# Keys that are missing, repeated and unmatched; attributes but nations are missing, too.
ROWS = {
    "region": ("r_regionkey INT, r_name VARCHAR", "(0, 'AFRICA'), (1, 'ASIA')"),
    "nation": ("n_nationkey INT, n_name VARCHAR, n_regionkey INT", "(3, 'x', 0), (12, 'y', 1)"),
    "customer": ("c_custkey BIGINT, c_nationkey INT", "(1, 3), (1, 12), (2, 7), (NULL, 3), (9, 3)"),
    "supplier": ("s_suppkey BIGINT, s_nationkey INT", "(1, 3), (2, 12), (2, 3), (3, 7), (NULL, 12)"),
    "part": (
        "p_partkey BIGINT, p_name VARCHAR, p_size INT",
        "(1, 'tin', 1), (2, 'blue ring', 5), (2, NULL, 50), (3, 'bolt', NULL), (4, 'bar', 41), (NULL, 'none', 7)",
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
        "(1, 1, 'O', '1995-05-01', '1-URGENT'), (2, 2, 'P', '1996-02-01', '2-HIGH'), (3, 1, 'F', '1998-12-31', '3-MEDIUM'),"
        " (4, 2, NULL, '1997-07-01', NULL), (4, 1, 'O', '2001-08-01', '5-LOW'), (5, 1, 'P', NULL, '4-NOT SPECIFIED'),"
        " (6, NULL, 'O', '1996-01-01', '1-URGENT'), (7, 8, 'O', '1996-01-01', '1-URGENT'), (NULL, 1, 'F', '1996-01-01', '2-HIGH')",
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE,"
        " l_returnflag VARCHAR, l_linestatus VARCHAR",
        ", ".join(
            f"({order}, {part}, {supplier}, {number}, {quantity}, {price}, {flag}, {status})"
            for order in (1, 2, 3, 4, 5, 6, 7, 8, "NULL")
            for part, supplier, number, quantity, price, flag, status in (
                (1, 1, 1, 1, 10.5, "'A'", "'O'"),
                (2, 2, 7, 50, 1234.56, "'N'", "'F'"),
                (3, 3, 6, 3, "NULL", "NULL", "NULL"),
                (4, 1, 7, "NULL", 99.99, "'A'", "'F'"),
                (2, 2, "NULL", 2, 0.07, "'R'", "'O'"),
                (9, 1, 2, 2, 5, "'A'", "'O'"),
                (1, 9, 3, 2, 5, "'A'", "'O'"),
                ("NULL", 1, 4, 2, 5, "'A'", "'O'"),
                (1, "NULL", 5, 2, 5, "'A'", "'O'"),
            )
        ),
    ),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for name, (columns, values) in ROWS.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.execute(f"INSERT INTO {name} VALUES {values}")
        con.execute(f"COPY {name} TO '{at}/{name}.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize(
    "name",
    ["scan_production", "scan_trade_regime", "scan_consumption_regime", "percent_export_total", "join_production_year"],
)
def test_missing_repeated_and_unmatched_keys_as_in_sql(spark, folder, name, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert compare.difference(spark, compare.database(folder), folder, name) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles_of(plan: str, scanned: str) -> list[str]:
    """The shuffles, as lines of the plan, that rows of the scan with this column go through."""
    lines = [(min(i for i, c in enumerate(line) if c not in " :+-*"), line) for line in plan.splitlines() if line.strip(" :+-*")]
    found = []
    for i, (depth, line) in enumerate(lines):
        end = next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))
        if "Exchange hashpartitioning(" in line and any("FileScan" in x and scanned in x for _, x in lines[i:end]):
            found.append(line)
    return found


@pytest.mark.parametrize(
    "name", ["prod", "scan_production", "percent_export_lookups", "union_tagged", "round_digits", "join_production_year"]
)
def test_line_items_are_not_shuffled_by_customer(spark, name):
    """F1 to F9: where nothing is broadcast, customers meet the orders, and line items
    are shuffled for their order, supplier and part only, without the text of a flag."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.queries()[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = shuffles_of(plan, "l_orderkey")
    assert not [x for x in shuffles if "custkey" in x]
    facts = sum("FileScan" in x and "l_orderkey" in x for x in plan.splitlines())
    for key in ("l_orderkey", "l_suppkey", "l_partkey"):
        assert sum(f"hashpartitioning({key}" in x for x in shuffles) == facts
    assert "hashpartitioning(o_custkey" in plan


ONE_PASS = [
    "percent_export_total",
    "union_tagged",
    "percent_export_by_source",
    "round_digits",
    "join_production_share",
    "join_production_year",
]


# Line items that are food trade, of parts and suppliers that repeat, with flags missing.
FOOD = ", ".join(
    f"({order}, {part}, {supplier}, {number}, 3, {price}, {flag}, {status})"
    for order in (1, 4, 5, 8)
    for part, supplier, number, price, flag, status in (
        (2, 2, 1, 20.5, "'A'", "'O'"),
        (4, 1, 7, 7.25, "'N'", "'F'"),
        (2, 1, "NULL", 1.5, "NULL", "'O'"),
        (4, 2, 2, 0.1, "'A'", "NULL"),
    )
)


@pytest.fixture(scope="module")
def food_folder(folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("food")
    con = duckdb.connect()
    for name in ROWS:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        if name == "lineitem":
            con.execute(f"INSERT INTO {name} VALUES {FOOD}")
        con.execute(f"COPY {name} TO '{at}/{name}.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("name", [*ONE_PASS, "prod", "percent_export_lookups"])
def test_shares_and_production_of_odd_keys_as_in_sql(spark, food_folder, name, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert compare.difference(spark, compare.database(food_folder), food_folder, name) is None
        assert registry.queries()[name](spark, food_folder).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ONE_PASS)
def test_trade_and_production_are_shuffled_once_for_both(spark, name):
    """F2 to F7: what a run has read and shuffled, equal branches counted once."""
    df = registry.queries()[name](spark, SMALL)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "== Final Plan ==" in final
    assert sum("FileScan" in x and "l_orderkey" in x for x in final.splitlines()) == 1


@pytest.mark.parametrize("regime", [None, "late"])
@pytest.mark.parametrize("dataset", [trade.percent_export_by_source, trade.percent_export_total])
def test_one_pass_over_records_equals_one_over_each_table(spark, food_folder, dataset, regime):
    tables = fixtures.FixtureTables(spark, food_folder)
    apart = TradeTables(**{name: getattr(tables, name) for name in schemas.TABLES})
    settings = {} if regime is None else {"regimes": regimes.regime_table(spark, fixtures.LATE_REGIME, regime), "regime": regime}
    together, separately = (dataset(Study(t, **settings)) for t in (tables, apart))
    assert sorted(map(str, together.collect())) == sorted(map(str, separately.collect()))
    assert not together.isEmpty()


def test_line_items_are_shuffled_by_order_as_few_columns(spark):
    """F8: one number for all flags, a weight and the three keys."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(registry.queries()["prod"](spark, SMALL)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = next(lines[i + 1] for i, x in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in x)
    assert re.findall(r" AS (\w+)#", below) == ["kind", "live_weight_t"]
