import pytest
from pyspark.sql import functions as F

from checks import fixtures
from tests.conftest import SMALL, plan_of
from tradeweave.plans import trade
from tradeweave.plans.study import Study, code_in
from tradeweave.sources import schemas, sinks
from tradeweave.sources.regimes import in_regime_table, regime_table, regime_years
from tradeweave.sources.tables import (
    TradeTables,
    list_tables,
    read_csv,
    read_csv_checked,
    row_counts,
    versions_by_jdbc,
    year_parts,
)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The fixture tables written the way the library lays them out."""
    root = str(tmp_path_factory.mktemp("tables"))
    sinks.write_tables(fixtures.study(spark, SMALL).tables, root)
    return root


def test_regime_filter_prunes_partitions_and_columns(spark, stored):
    s = Study(TradeTables.from_parquet(spark, stored))
    plan = plan_of(trade.export_by_source(s))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [((" in scan and "HS96" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    pushed = scan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "IsNotNull(product_weight_t)" in pushed and "GreaterThanOrEqual(live_weight_t,0.10)" in pushed
    schema = scan.split("ReadSchema")[1]
    assert "exporter_iso3c" not in schema and "record_id" not in schema


def test_source_filter_reaches_the_scan(spark, stored):
    s = Study(TradeTables.from_parquet(spark, stored))
    pushed = plan_of(trade.top_exporters_new(s)).split("PushedFilters")[1].split("ReadSchema")[0]
    assert "In(habitat, [inland,marine])" in pushed and "In(method, [aquaculture,capture])" in pushed


def test_stored_tables_give_the_same_result(spark, stored, study):
    s = Study(TradeTables.from_parquet(spark, stored))
    a, b = trade.export_concentration_n_countries(s), trade.export_concentration_n_countries(study)
    assert sorted(a.collect()) == sorted(b.collect())


def test_code_test_reaches_the_scan(spark, stored):
    df = TradeTables.from_parquet(spark, stored).snet
    plan = plan_of(df.where(code_in(df, ["230120", "030110"])))
    assert "In(hs6, [230120,30110])" in plan.split("PushedFilters")[1]
    texts = spark.createDataFrame([("30110",), ("030110",), ("301100",), (None,)], "hs6 string")
    assert texts.where(code_in(texts, ["030110"])).count() == 2


def test_catalog_tables(spark, stored):
    for name in schemas.TABLES:
        spark.read.parquet(f"{stored}/{name}").createOrReplaceTempView(name)
    listed = list_tables(spark).collect()
    assert set(schemas.TABLES) <= {r.table_name for r in listed}
    columns = {r.column_name: (r.position, r.data_type) for r in listed if r.table_name == "population"}
    assert columns == {"record_id": (1, "bigint"), "iso3c": (2, "string"), "year": (3, "int"), "pop": (4, "bigint")}
    tables = TradeTables.from_catalog(spark)
    counts = {r.table_name: r.n_rows for r in row_counts(tables).collect()}
    assert counts["snet"] == counts["production"] == 6000 and counts["population"] == 671
    for name in schemas.TABLES:
        spark.catalog.dropTempView(name)


def test_csv_keeps_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.5), (2, "a, b", None)], "i int, s string, x double")
    sinks.write_csv(df, str(tmp_path / "t"))
    assert sorted(read_csv(spark, str(tmp_path / "t"), df.schema).collect()) == sorted(df.collect())
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert "NA" in text and text.startswith("i,s,x")


def test_records_that_do_not_fit_are_set_aside(spark, tmp_path):
    lines = ["i,s,x", "1,a,2.5", "x,b,1.0", "2,c", "3,d,1.0,more", "4,NA,NA", "5,,", "6,e,1.2.3", '7,"f, g",0']
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    schema = spark.createDataFrame([], "i int, s string, x double").schema
    checked = read_csv_checked(spark, str(tmp_path / "t.csv"), schema)
    assert sorted(checked.rows.collect()) == [(1, "a", 2.5), (4, None, None), (5, None, None), (7, "f, g", 0.0)]
    assert sorted(r.record for r in checked.rejected.collect()) == sorted(lines[i] for i in (2, 3, 4, 7))
    assert {r.file for r in checked.rejected.collect()} == {"t.csv"}
    # a fault in a column that is not asked for counts as well
    assert checked.rows.select("s").count() == 4 and checked.rejected.count() == 4
    assert checked.counts().collect() == [(4, 4)]
    assert read_csv(spark, str(tmp_path / "t.csv"), schema).count() == 8


def test_folders_of_a_regime_table_are_chosen_while_running(spark, study):
    from checks.operators import OPERATORS

    plan = plan_of(OPERATORS["scan_trade_laid_out"](study))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "record_id" in line)
    assert "dynamicpruning" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    snet, table = study.tables.laid_out()
    years = {(r.hs_version, r.year) for r in in_regime_table(snet, table, "late").select("hs_version", "year").collect()}
    assert {v for v, y in years} == {"HS96", "HS17"}
    assert all((v == "HS96" and y < 2000) or (v == "HS17" and y > 2015) for v, y in years)
    assert in_regime_table(snet, table, "no such name").count() == 0


def test_regime_ranges_may_overlap_and_be_open(spark):
    table = regime_table(spark, [("HS96", 1996, 1999), ("HS96", 1998, 2001), ("HS02", None, 1995), ("HS07", 2005, 2004)])
    years = sorted((r.hs_version, r.year) for r in regime_years(table).collect())
    assert [y for v, y in years if v == "HS96"] == [1996, 1997, 1998, 1999, 2000, 2001]
    assert [y for v, y in years if v == "HS02"] == list(range(1900, 1996)) and not [y for v, y in years if v == "HS07"]
    assert min(r.year for r in regime_years(table, open_start=True).where("hs_version = 'HS96'").collect()) == 1900


def test_a_regime_table_gives_what_the_ranges_give(spark, study):
    from dataclasses import replace

    by_table = replace(study, regimes=regime_table(spark))
    for dataset in (trade.export_by_source, trade.custom_ts, trade.trade_ts_union, trade.fishmeal_trade):
        assert sorted(dataset(by_table).collect(), key=str) == sorted(dataset(study).collect(), key=str)
        shared = by_table.with_shared_trade()
        assert sorted(map(str, dataset(shared).collect())) == sorted(map(str, dataset(study).collect()))


class _Reader:
    """Records what a database reader is asked for; there is no database here."""

    def __init__(self):
        self.calls = {}

    def jdbc(self, url, name, **options):
        self.calls[name] = options
        return name

    def format(self, kind):
        return self

    def options(self, **options):
        self.calls["options"] = options
        return self

    def load(self):
        return "loaded"


def test_large_database_tables_are_read_in_parts_of_years():
    class session:
        read = _Reader()

    TradeTables.from_jdbc(session, "jdbc:postgresql:trade", {"user": "u"}, parts_per_year=4)
    calls = session.read.calls
    assert set(calls) == set(schemas.TABLES)
    assert {n for n, o in calls.items() if "predicates" in o} == {"snet", "production", "consumption"}
    assert len(calls["snet"]["predicates"]) == 26 * 4
    versions_by_jdbc(session, "jdbc:postgresql:trade", {"user": "u"})
    assert "GROUP BY year, hs_version" in calls["options"]["query"]


@pytest.mark.parametrize("per_year", [1, 3, 8])
def test_every_row_is_in_one_part(spark, per_year):
    rows = [(y, k) for y in (None, 1900, 1996, 2019, 2020, 2021) for k in (None, -7, -1, 0, 1, 7, 8)]
    df = spark.createDataFrame(rows, "year int, record_id long")
    parts = sum((F.expr(p).cast("int") for p in map("coalesce({}, false)".format, year_parts(per_year))), F.lit(0))
    assert {r.n for r in df.select(parts.alias("n")).collect()} == {1}


def test_shared_folder_is_the_configured_one(spark, tmp_path):
    assert sinks.shared_dir(spark) == sinks.shared_dir(spark)
    again = sinks.materialise(spark.range(5).withColumn("x", F.lit("a")), "numbers")
    assert again.count() == 5 and "numbers" in again.inputFiles()[0]
    assert sinks.shared_dir(spark) in again.inputFiles()[0]


class _Cluster:
    """Stands in for a session on a cluster without the setting."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "yarn"


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        sinks.shared_dir(_Cluster)
