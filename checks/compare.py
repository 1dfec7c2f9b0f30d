"""Run queries and their SQL side by side: ``python -m checks.compare [folder] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import oracle, registry

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tradeweave-checks")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows(names, values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in values)


def difference(spark: SparkSession, con, folder: str, name: str) -> str | None:
    """What differs between the two results of a query; None if nothing does."""
    df = registry.queries()[name](spark, folder)
    ours = rows(df.columns, df.collect())
    result = con.execute(oracle.SQL[name])
    columns = [c[0] for c in result.description]
    theirs = rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if ours != theirs:
        extra, absent = ours - theirs, theirs - ours
        return (
            f"rows {sum(ours.values())} vs {sum(theirs.values())}, differing {sum(extra.values())}; "
            f"ours {list(extra)[:3]} theirs {list(absent)[:3]}"
        )
    kinds = {tuple(type(_value(v)).__name__ for v in r) for r in list(ours)[:50]}
    other = {tuple(type(_value(v)).__name__ for v in r) for r in list(theirs)[:50]}
    if not {k for t in kinds for k in t} <= {k for t in other for k in t} | {"NoneType"}:
        return f"types {kinds} != {other}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.queries())
    spark, con, bad = session(os.environ.get("CHECK_CPUS", "8")), database(folder), 0
    for name in names:
        start = time.time()
        if name not in oracle.SQL:
            print(f"{name}: no SQL")
            continue
        try:
            problem = difference(spark, con, folder, name)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            bad += 1
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree; SQL without a query: {sorted(oracle.SQL.keys() - registry.queries().keys())}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
