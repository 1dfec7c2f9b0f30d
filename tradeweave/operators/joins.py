"""Joins whose missing-value and size behaviour is stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _match(left: Column, right: Column, null_safe: bool) -> Column:
    return left.eqNullSafe(right) if null_safe else left == right


def one_row_per_key(table: DataFrame, keys: Sequence[str], name: str, null_safe: Sequence[str] = ()) -> DataFrame:
    """The table, with a key that repeats as an error that names it.

    Nothing runs when this is called: the test is part of the plan, on the table
    grouped by its key, and fails the job that reads the columns of such a row. Rows
    with a missing key match nothing, so they may repeat, unless the key is in
    ``null_safe``.
    """
    rest = [c for c in table.columns if c not in keys]
    found = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("missing"))) for k in keys]
    message = F.concat(
        F.lit(f"{name}: "), F.concat_ws(", ", *found), F.lit(" occurs "), F.col("_rows").cast("string"), F.lit(" times")
    )
    repeats = F.col("_rows") > 1
    for k in keys:
        if k not in null_safe:
            repeats = repeats & F.col(k).isNotNull()
    grouped = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in rest])
    checked = [F.when(repeats, F.raise_error(message)).otherwise(F.col(c)).alias(c) for c in rest]
    return grouped.select(*keys, *checked)


def key_report(table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How a table's key holds: one row of table_name, n_rows, n_keys, n_repeated, n_missing.

    ``n_repeated`` counts the keys with more than one row, ``n_missing`` the rows of
    which a part of the key is missing; those are not keys.
    """
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    groups = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_whole", whole)
    return groups.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("_whole")).alias("n_keys"),
        F.count_if(F.col("_whole") & (F.col("_rows") > 1)).alias("n_repeated"),
        F.coalesce(F.sum(F.when(~F.col("_whole"), F.col("_rows"))), F.lit(0)).alias("n_missing"),
    ).select(F.lit(name).alias("table_name"), "n_rows", "n_keys", "n_repeated", "n_missing")


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Mapping[str, str],
    take: Mapping[str, str],
    null_safe: Sequence[str] = (),
    unique: str = "",
) -> DataFrame:
    """Left join that brings in columns of another table.

    ``on`` maps columns of ``df`` to columns of ``table``; ``take`` maps new names
    to columns of ``table``. Columns in ``null_safe`` match missing with missing,
    which costs a little and is only needed where both sides can be missing.

    With ``unique``, the table's name, a key that occurs twice in ``table`` is an error
    (see ``one_row_per_key``); without, each of its rows gives a row.

    No hint is given: a table read from files is broadcast by Spark when its size
    is under ``spark.sql.autoBroadcastJoinThreshold``, and joined by sort-merge,
    with skewed partitions split, when it is not.
    """
    table = table.select(*dict.fromkeys([*on.values(), *take.values()]))
    if unique:
        table = one_row_per_key(table, [*on.values()], unique, [b for a, b in on.items() if a in null_safe])
    fact, dim = df.alias("fact"), table.alias("dim")
    terms = [_match(F.col(f"fact.{a}"), F.col(f"dim.{b}"), a in null_safe) for a, b in on.items()]
    return fact.join(dim, reduce(lambda x, y: x & y, terms), "left").select(
        "fact.*", *[F.col(f"dim.{source}").alias(name) for name, source in take.items()]
    )


def name_key(name: Column | str) -> Column:
    """What a name is compared by: punctuation counts as a blank, "&" as "and", blanks at
    the ends or in a row do not count, and case and accents make no difference."""
    name = F.col(name) if isinstance(name, str) else name
    plain = F.regexp_replace(name, "&", " and ")
    plain = F.trim(F.regexp_replace(plain, r"[\p{P}\s]+", " "))
    return F.collate(plain, "UNICODE_CI_AI")


def code_for_name(
    df: DataFrame, name: str, codes: DataFrame, code: str = "iso3c", aliases: DataFrame | None = None
) -> DataFrame:
    """Country codes for names, from a table of (name, iso3c) and one of other spellings.

    Names are compared by ``name_key``; an unknown name has no code. Several spellings
    may share a code; a spelling with two codes is an error that names it.
    """
    known = codes.select("name", "iso3c")
    if aliases is not None:
        known = known.unionByName(aliases.select("name", "iso3c"))
    known = known.where(F.col("iso3c").isNotNull()).select(name_key("name").alias("_name"), F.col("iso3c").alias("_code")).distinct()
    rows = df.withColumn("_name", name_key(name))
    return lookup(rows, known, {"_name": "_name"}, {code: "_code"}, unique="country names").drop("_name")


def full_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join on keys of the same name; missing keys match each other."""
    a, b = left.alias("a"), right.alias("b")
    condition = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, condition, "full").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[F.col(f"a.{c}") for c in left.columns if c not in keys],
        *[F.col(f"b.{c}") for c in right.columns if c not in keys],
    )


def without_keys(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys_table`` (missing keys included)."""
    condition = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return df.alias("a").join(keys_table.select(*keys).alias("b"), condition, "left_anti")
