"""Writing results, and tables that several plans share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.sources import schemas
from tradeweave.sources.tables import CSV_OPTIONS, TradeTables

_local_dirs: dict[str, str] = {}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and "NA" for missing values; no row names."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, optionally laid out by columns.

    The rebalance hint gives files of an even size: a value that holds much of the
    data is split over several tasks and files, small ones share a task.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_years(df: DataFrame, path: str) -> list[int]:
    """Bring a table laid out by year up to date; returns the years written.

    What is there is compared year by year: number of rows and the sum of hashes over
    all columns. Only years that differ are replaced, each as a whole, and years that
    no longer occur are deleted; without a table at ``path`` all are written. A year is
    replaced by Spark's dynamic partition overwrite when the job commits, so a failed
    run leaves the old ones.
    """
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        write_parquet(df, path, ["year"])
        return sorted(r["year"] for r in spark.read.parquet(path).select("year").distinct().collect() if r["year"] is not None)
    old = spark.read.schema(df.schema).parquet(path)
    columns = sorted(df.columns)

    def years(table: DataFrame) -> dict:
        digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
        rows = table.groupBy("year").agg(F.count(F.lit(1)).alias("n"), digest.alias("h")).collect()  # a row per year
        return {r["year"]: (r["n"], r["h"]) for r in rows}

    before, now = years(old), years(df)
    changed = [y for y in now if now[y] != before.get(y)]
    if changed:
        # Spark writes a missing year to a folder of its own
        rows = df.where(F.col("year").isin([y for y in changed if y is not None]) | (F.lit(None in changed) & F.col("year").isNull()))
        rows.hint("rebalance", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "year"
        ).parquet(path)
    for y in before.keys() - now.keys():
        delete(spark, f"{path}/year={'__HIVE_DEFAULT_PARTITION__' if y is None else y}")
    return sorted(y for y in changed if y is not None)


def write_tables(tables: TradeTables, root: str, only: Sequence[str] = tuple(schemas.TABLES)) -> None:
    """Write every table below ``root``, or some, for ``TradeTables.from_parquet``.

    The two large ones are laid out by version and year, so that the regime filter
    opens only matching folders.
    """
    for name in only:
        table = getattr(tables, name).select(*schemas.TABLES[name].fieldNames())
        write_parquet(table, f"{root}/{name}", schemas.PARTITIONED.get(name, ()))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tradeweave-")
    return _local_dirs[app]


def _located(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _located(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    p, fs = _located(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    p, fs = _located(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a temporary name and give it its name when it is whole."""
    p, fs = _located(spark, path)
    temporary, _ = _located(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(temporary, p)


def input_state(df: DataFrame) -> list[str] | None:
    """Path, length and time of every file that a table is read from; None without files."""
    spark, out = df.sparkSession, []
    for path in sorted(df.inputFiles()):
        p, fs = _located(spark, path)
        status = fs.getFileStatus(p)
        out.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return out or None


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lineage ends there, lost executors do not cost a recomputation, and Spark knows
    the size of the result when it plans what follows.
    """
    return SharedTables(df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}").keep(
        df, name, partition_by
    )


class SharedTables:
    """Tables that the datasets of one run share, in one folder.

    A table that was written to the end before is read instead of written again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def keep(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_folder = self.folder
        return out

    def drop(self) -> None:
        delete(self.spark, self.folder)


def remove(table: DataFrame) -> None:
    """Delete what ``materialise`` wrote for a table that nothing needs any more."""
    delete(table.sparkSession, table._shared_folder)


def passing_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def tidy() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass

    atexit.register(tidy)
    return path
