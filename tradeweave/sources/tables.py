"""The input tables, read from files, a catalog or a database."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tradeweave.functions.domains import COUNTRY_ALIASES, LDC_CODE_BY_NAME, REGIMES
from tradeweave.sources import schemas

# Years of the authoritative versions, the ranges a database is read by.
FIRST_YEAR, LAST_YEAR = REGIMES[0][1], REGIMES[-1][2] + 1

CSV_OPTIONS = {"header": True, "nullValue": "NA"}


@dataclass(frozen=True)
class TradeTables:
    snet: DataFrame
    production: DataFrame
    countries: DataFrame
    code_max_resolved_taxa: DataFrame
    sciname: DataFrame
    population: DataFrame
    consumption: DataFrame
    centroids: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> TradeTables:
        return cls(**{name: spark.read.schema(s).parquet(f"{root}/{name}") for name, s in schemas.TABLES.items()})

    @classmethod
    def from_csv(cls, spark: SparkSession, root: str) -> TradeTables:
        return cls(**{name: read_csv(spark, f"{root}/{name}.csv", s) for name, s in schemas.TABLES.items()})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None, prefix: str = "") -> TradeTables:
        """Tables or views of the declared names, in a database or under a prefix."""
        where = f"{database}." if database else ""
        return cls(**{name: spark.table(where + prefix + name) for name in schemas.TABLES})

    @classmethod
    def from_jdbc(
        cls, spark: SparkSession, url: str, properties: dict[str, str], parts_per_year: int = 8
    ) -> TradeTables:
        """Tables in a database.

        The large tables are read by years and, within a year, by remainders of the
        record number, in parallel. Every row, also one without a year or a number,
        is in exactly one part. Filters on plain columns, such as the regime filter,
        become part of each part's query.
        """

        def read(name: str) -> DataFrame:
            if name in schemas.BY_YEAR:
                return spark.read.jdbc(url, name, predicates=year_parts(parts_per_year), properties=properties)
            return spark.read.jdbc(url, name, properties=properties)

        return cls(**{name: read(name) for name in schemas.TABLES})

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]

    def register(self, prefix: str = "") -> list[str]:
        """Put every table into the session's catalog as a view; returns their names.

        ``from_catalog`` reads them back.
        """
        return register(self, prefix)


def year_parts(per_year: int) -> list[str]:
    """Conditions that share rows out by year and by remainder of the record number."""
    years = [f"year = {y}" for y in range(FIRST_YEAR, LAST_YEAR)]
    years += [f"(year < {FIRST_YEAR} OR year >= {LAST_YEAR} OR year IS NULL)"]
    if per_year < 2:
        return years
    rests = [f"ABS(MOD(record_id, {per_year})) = {k}" for k in range(per_year)]
    rests[0] = f"({rests[0]} OR record_id IS NULL)"
    return [f"{year} AND {rest}" for year in years for rest in rests]


def versions_by_jdbc(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """Product weight by year and version, summed inside the database."""
    query = (
        "SELECT year, hs_version, SUM(product_weight_t) AS product_weight_t FROM snet GROUP BY year, hs_version"
    )
    return spark.read.format("jdbc").options(url=url, query=query, **properties).load()


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header and "NA" for missing values.

    A cell that does not fit its type is missing; ``read_csv_checked`` tells them.
    """
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


@dataclass(frozen=True)
class CheckedCsv:
    """Rows that fit the declared types, and the text of those that do not."""

    rows: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """One row: n_rows, n_rejected. Reads the files once for each."""
        rows = self.rows.agg(F.count(F.lit(1)).alias("n_rows"))
        return rows.withColumn("n_rejected", self.rejected.agg(F.count(F.lit(1))).scalar())


def read_csv_checked(spark: SparkSession, path: str, schema, header: bool = True) -> CheckedCsv:
    """CSV as ``read_csv`` reads it, with the records that do not fit set aside.

    A record is rejected when a cell cannot be read as its type, or when it has fewer
    or more cells than the schema; "NA" and empty cells are missing and fit. ``rejected``
    holds the file and the record as it stands there. Both are lazy. All columns are
    parsed whatever is selected, or a fault in an unused one would go unseen.
    """
    wide = StructType([*schema.fields, StructField("_record", StringType(), True)])
    options = CSV_OPTIONS | {
        "header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record", "columnPruning": False,
    }
    read = spark.read.schema(wide).options(**options).csv(path)
    # Spark refuses to read the record alone; a test that is always true reads the cells
    parsed = F.xxhash64(*schema.fieldNames()) >= F.lit(-(1 << 63)).cast("long")
    read = read.select("*", F.col("_metadata.file_name").alias("_file")).where(parsed)
    return CheckedCsv(
        rows=read.where(F.col("_record").isNull()).select(*schema.fieldNames()),
        rejected=read.where(F.col("_record").isNotNull()).select(
            F.col("_file").alias("file"), F.col("_record").alias("record")
        ),
    )


def country_names(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Names of the least developed countries with their codes, and other spellings of them."""
    kind = "name string, iso3c string"
    return tuple(spark.createDataFrame(list(m.items()), kind) for m in (LDC_CODE_BY_NAME, COUNTRY_ALIASES))


def register(tables, prefix: str = "") -> list[str]:
    """Put tables into the session's catalog as views named by the declared names."""
    names = [f"{prefix}{name}" for name in schemas.TABLES]
    for name in schemas.TABLES:
        getattr(tables, name).createOrReplaceTempView(f"{prefix}{name}")
    return names


def list_tables(spark: SparkSession, database: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tables and views in the catalog with their columns, one row per column.

    Columns: table_name, table_type, is_temporary, position, column_name, data_type.
    ``pattern`` is as in SHOW TABLES. The catalog is metadata; no table is read.
    """
    rows = []
    for t in spark.catalog.listTables(database, pattern):
        name = ".".join([*(t.namespace or []), t.name]) if not t.isTemporary else t.name
        for i, c in enumerate(spark.catalog.listColumns(name)):
            rows.append((t.name, t.tableType, t.isTemporary, i + 1, c.name, c.dataType))
    kind = "table_name string, table_type string, is_temporary boolean, position int, column_name string, data_type string"
    return spark.createDataFrame(rows, kind)


def row_counts(tables: TradeTables) -> DataFrame:
    """What is loaded, and how much of it."""
    counts = [
        getattr(tables, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name in tables.names()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
