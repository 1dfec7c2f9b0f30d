"""Trade tables derived from the generated star schema (see FIXTURES.md).

A line item is a trade record: the supplier's nation exports, the customer's
nation imports, and each calendar quarter stands for one year.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.plans.study import Study
from tradeweave.sources import regimes, schemas, sinks

# Versions that count in another reading of the data: the newest from 2016 on, the oldest before 2000.
LATE_REGIME = (("HS96", None, 1999), ("HS17", 2016, None))

# Country names as customers spell them; whose they are is stated in the SQL.
COUNTRY_SPELLINGS = (
    "Afghanistan", "ANGOLA", "bangladesh", "Bénin", " Bhutan ", "Burkina-Faso", "Burkina Faso", "Burundi",
    "Cambodia", "Central African Republic", "Central African Rep", "Chad", "Comoros", "COMORES",
    "Congo, Dem. Rep.", "DR Congo", "Democratic Republic of the Congo", "DJIBOUTI", "Eritrea", "Ethiopia",
    "Gambia", "the gambia", "Guinea", "Guinea-Bissau", "Guinea Bissau", "Haïti", "Kiribati",
    "Lao People’s Dem. Republic", "Lao People's Dem. Republic", "lao pdr", "Lesotho", "liberia", "Madagascar",
    "Malawi", "Mali", "Mauritania", "Mozambique", "Myanmar", "BURMA", "Népal", "Niger", "Niger.", "Rwanda",
    "Sao Tome and Principe", "São Tomé & Príncipe", "Sénégal", "Sierra  Leone", "Solomon Islands", "Solomon Is",
    "Somalia", "South Sudan", "S. Sudan", "Sudan", "Timor-Leste", "timor leste", "East Timor", "Togo", "Tuvalu",
    "Uganda", "United Republic of Tanzania", "Tanzania", "Yemen", "Yemen, Rep.", "Zambia",
    "Nigeria", "Equatorial Guinea", "Republic of the Congo", "Mauritius", "Sudan (former)", "", "Dominican Republic",
    "Zambiaa", "Niger ia", None,
)

LDC_CODES = ("N00", "N03", "N05", "N08", "N10", "N13")
CENTROID_OVERRIDES = {"N07": (172.9717, 1.4518)}
WEIGHT = "decimal(18,2)"
# What a line item says about its source, as bits of one number.
FLAGS = {"MARINE": 1, "FARMED": 2, "SEVENTH": 4, "UNKNOWN": 8}


# Columns in use, declared so that no job has to look at the files first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_linestatus string",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def code(nationkey: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(nationkey).cast("string"), 2, "0"))


def _choose(c: Column, otherwise, **cases) -> Column:
    """First matching equality; ``cases`` maps results to values."""
    chain = F
    for result, value in cases.items():
        chain = chain.when(c == value, F.lit(result))
    return chain.otherwise(otherwise)


def _year(date: str) -> Column:
    return (F.lit(1995) + 4 * (F.year(date) - 1995) + F.quarter(date) - 1).cast("int")


def _flags(**conditions: Column) -> Column:
    """The named flags whose condition holds, as one number: side by side they take more room in a shuffle."""
    return sum((F.when(c, F.lit(FLAGS[name])).otherwise(F.lit(0)) for name, c in conditions.items()), F.lit(0))


def _has(flag: str) -> Column:
    return F.col("kind").bitwiseAND(F.lit(FLAGS[flag])) != 0


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation and what an order says about its line items."""
    status, date = F.col("o_orderstatus"), F.col("o_orderdate")
    orders = base(spark, sf_dir, "orders").select(
        _year("o_orderdate").alias("year"),
        ((status == "P") | (F.year(date) == 1998)).alias("doubtful"),
        _choose(
            F.col("o_orderpriority"), F.lit("HS17"),
            HS96="1-URGENT", HS02="2-HIGH", HS07="3-MEDIUM", HS12="4-NOT SPECIFIED",
        ).alias("hs_version"),
        _choose(status, F.lit("error"), domestic="O", foreign="F").alias("dom_source"),
        "o_custkey",
        "o_orderkey",
    )
    customer = base(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flags, numbers and fixed-point weights."""
    number = F.col("l_linenumber")
    product = F.when(F.col("l_quantity") != 50, F.col("l_quantity")).cast(WEIGHT)
    live = F.when(F.col("l_quantity") == 1, F.lit(0.05)).otherwise(F.col("l_extendedprice")).cast(WEIGHT)
    return base(spark, sf_dir, "lineitem").select(
        _flags(MARINE=F.col("l_linestatus") == "O", FARMED=F.col("l_returnflag") == "A", SEVENTH=number == 7).alias("kind"),
        (live.isNotNull() & product.isNotNull()).alias("weighed"),
        number.alias("linenumber"),
        product.alias("product_weight_t"),
        live.alias("live_weight_t"),
        "l_suppkey",
        "l_partkey",
        "l_orderkey",
    )


def _with_orders(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    joined = lines.join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.when(_has("SEVENTH") & F.col("doubtful"), F.lit(FLAGS["UNKNOWN"])).otherwise(F.col("kind")).alias("kind"),
        "year",
        "hs_version",
        "dom_source",
        "c_nationkey",
        *[c for c in lines.columns if c not in ("kind", "l_orderkey")],
        (F.col("l_orderkey") * 10 + F.col("linenumber")).alias("record_id"),
    )


def _with_suppliers(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    joined = lines.join(base(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("s_nationkey", *[c for c in lines.columns if c != "l_suppkey"])


def _with_parts(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    size = F.col("p_size")
    hs6 = (
        F.when(size == 1, 30110)
        .when(size == 2, 30111)
        .when(size == 3, 30119)
        .when(size <= 6, 230120)
        .when(size == 50, F.lit(None))
        .when(size > 40, 160400 + size)
        .otherwise(30200 + size)
    )
    part = base(spark, sf_dir, "part").select("p_partkey", hs6.cast("int").alias("hs6"), F.col("p_name").alias("sciname"))
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("hs6", *[c for c in lines.columns if c != "l_partkey"], "sciname")


def _lines(spark: SparkSession, sf_dir: str, orders_last: bool = False) -> DataFrame:
    """One row per line item with everything the trade tables need.

    None of the tables is small when the data are large, so every join may shuffle.
    Customers meet the orders, which are fewer than their line items; line items are
    shuffled for their order, supplier and part only, as flags, numbers and fixed-point
    weights side by side, few values first, which compress well. Text is written out
    after the last join.

    A join's columns go through the shuffles after it. Names of parts are the widest, so
    parts come last; with ``orders_last``, for uses without names, orders do.
    """
    steps = [_with_orders, _with_suppliers, _with_parts]
    lines = _items(spark, sf_dir)
    for step in [*steps[1:], steps[0]] if orders_last else steps:
        lines = step(spark, sf_dir, lines)
    return lines.select(
        "record_id",
        "year",
        "hs_version",
        "hs6",
        code("s_nationkey").alias("exporter_iso3c"),
        code("c_nationkey").alias("importer_iso3c"),
        "sciname",
        F.when(_has("UNKNOWN"), "unknown").when(_has("MARINE"), "marine").otherwise("inland").alias("habitat"),
        F.when(_has("UNKNOWN"), "unknown").when(_has("FARMED"), "aquaculture").otherwise("capture").alias("method"),
        "dom_source",
        "live_weight_t",
        "product_weight_t",
        "linenumber",
        "weighed",
    )


def _countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("r_name")
    owid_region = (
        F.when(region == "AFRICA", "Africa")
        .when(region == "EUROPE", "Europe")
        .when(region == "MIDDLE EAST", "Other nei")
        .when(key.isin(1, 6, 11), "North America")
        .when(region == "AMERICA", "South America")
        .when(key == 22, "Oceania")
        .otherwise("Asia")
    )
    return (
        base(spark, sf_dir, "nation")
        .where(key != 24)
        .join(base(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(key.alias("record_id"), code("n_nationkey").alias("iso3c"), owid_region.alias("owid_region"))
    )


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation, scaled, for every year with orders.

    The years are one short array, so every nation is repeated per year without a
    join.
    """
    years = base(spark, sf_dir, "orders").agg(F.collect_set(_year("o_orderdate")).alias("years")).scalar()
    key, year = F.col("c_nationkey"), F.col("year")
    return (
        base(spark, sf_dir, "customer")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("year", F.explode(years))
        .where((key != 23) | (year < 2018))
        .select(
            (key * 10000 + year).cast("long").alias("record_id"),
            code("c_nationkey").alias("iso3c"),
            "year",
            (F.col("customers") * (200000 + 2000 * (year - 1995))).cast("long").alias("pop"),
        )
    )


class FixtureTables:
    """The trade tables of one data folder, each set up when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = (spark, sf_dir)

    def names(self) -> list[str]:
        return list(schemas.TABLES)

    @cached_property
    def _lines(self) -> DataFrame:
        return _lines(*self._at)

    @cached_property
    def snet(self) -> DataFrame:
        return self._lines.drop("linenumber", "weighed")

    @cached_property
    def production(self) -> DataFrame:
        iso3c = F.col("exporter_iso3c").alias("iso3c")
        return self._lines.select("record_id", iso3c, "year", "sciname", "method", "habitat", "live_weight_t")

    @cached_property
    def records(self) -> DataFrame:
        """The rows of ``snet`` and of ``production``, which are the same records here, for
        uses that take both: without names, and with ``weighed``, whether both weights
        are present, in place of the product weight."""
        return _lines(*self._at, orders_last=True).drop("sciname", "linenumber", "product_weight_t")

    @cached_property
    def countries(self) -> DataFrame:
        return _countries(*self._at)

    @cached_property
    def code_max_resolved_taxa(self) -> DataFrame:
        return self._lines.groupBy("hs6").agg(F.min("record_id").alias("record_id"))

    @cached_property
    def sciname(self) -> DataFrame:
        name = F.col("sciname")
        return (
            base(*self._at, "part")
            .groupBy(F.col("p_name").alias("sciname"))
            .agg(F.min("p_partkey").alias("record_id"))
            .withColumn("common_name", F.when(name.startswith("blue"), F.concat(name, F.lit(" nei"))).otherwise(name))
        )

    @cached_property
    def population(self) -> DataFrame:
        return _population(*self._at)

    @cached_property
    def consumption(self) -> DataFrame:
        domestic = F.col("dom_source") == "domestic"
        source = F.when(domestic, F.col("importer_iso3c")).when(F.col("linenumber") == 6, F.lit("unknown"))
        return self._lines.select(
            "record_id",
            "year",
            "hs_version",
            F.col("importer_iso3c").alias("consumer_iso3c"),
            source.otherwise(F.col("exporter_iso3c")).alias("source_country_iso3c"),
            F.col("sciname").alias("sciname_hs_modified"),
            "habitat",
            "method",
            F.when(domestic, F.lit("domestic")).otherwise(F.lit("foreign")).alias("consumption_source"),
            F.col("live_weight_t").alias("consumption_live_t"),
        )

    @cached_property
    def centroids(self) -> DataFrame:
        key = F.col("n_nationkey")
        return base(*self._at, "nation").select(
            code("n_nationkey").alias("iso3"),
            F.when(key % 2 == 0, F.lit("adm")).otherwise(F.lit("admin1")).alias("adm1_code"),
            (key * 14 - 170).cast("double").alias("centroid_lon"),
            (key * 6 - 70).cast("double").alias("centroid_lat"),
        )


    def laid_out(self) -> tuple[DataFrame, DataFrame]:
        """Trade written by version and year, and a table of regimes, read back.

        Written once for a data folder, and deleted when the process ends.
        """
        return _laid_out(*self._at)

    def csv_lines(self) -> DataFrame:
        """Customers as lines of CSV: number, country, value. Of ten lines, one has no
        number in the first cell, one is short, one long, one has a broken value; the
        missing ones are spelled "NA" or left empty."""
        spark, sf_dir = self._at
        n, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 10
        country, value = code("c_nationkey"), (F.col("c_nationkey") * 100 + 7).cast("string")
        cells = F.when(kind == 1, F.concat_ws(",", F.concat(F.lit("x"), n), country, value))
        cells = cells.when(kind == 2, F.concat_ws(",", n, country))
        cells = cells.when(kind == 3, F.concat_ws(",", n, country, value, F.lit("more")))
        cells = cells.when(kind == 4, F.concat_ws(",", n, country, F.lit("NA")))
        cells = cells.when(kind == 5, F.concat_ws(",", n, F.lit("NA"), value))
        cells = cells.when(kind == 6, F.concat_ws(",", n, country, F.lit("12.5")))
        cells = cells.when(kind == 7, F.concat(n, F.lit(","), country, F.lit(",")))
        return base(spark, sf_dir, "customer").select(cells.otherwise(F.concat_ws(",", n, country, value)).alias("value"))


@lru_cache(maxsize=8)
def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    root = sinks.passing_folder(spark, "laid-out")
    sinks.write_tables(FixtureTables(spark, sf_dir), root, ["snet"])
    table = regimes.regime_table(spark).unionByName(regimes.regime_table(spark, LATE_REGIME, "late"))
    table.coalesce(1).write.parquet(f"{root}/regimes")
    return spark.read.schema(schemas.SNET).parquet(f"{root}/snet"), spark.read.schema(regimes.SCHEMA).parquet(f"{root}/regimes")


@lru_cache(maxsize=8)
def study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over a data folder. Only plans are kept between calls, no data."""
    return Study(FixtureTables(spark, sf_dir), ldc_codes=LDC_CODES, centroid_overrides=CENTROID_OVERRIDES)
