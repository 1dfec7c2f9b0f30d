"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch

#: A key is hot when it has more than one in so many of the rows: fewer keys can be.
HOT = 1000


def join_hot(rows: DataFrame, key: str, table: DataFrame, table_key: str, n: int) -> DataFrame:
    """Inner join of rows with a table that has each key once, whatever rows share a key.

    Keys with more than one in HOT of the ``n`` rows are joined where their rows are:
    there are fewer than HOT of them, so their part of the table is broadcast. The
    rest is joined as usual, and no task gets more than that share of the rows for one
    key.
    """
    counts = rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where((F.col("_n") > n // HOT) & F.col("_hot").isNotNull()).select("_hot")
    hot = F.broadcast(hot)  # fewer than HOT keys
    match = F.col(key) == F.col(table_key)
    few = F.broadcast(table.join(hot, F.col(table_key) == F.col("_hot"), "left_semi"))  # a row per hot key
    rest = rows.join(hot, F.col(key) == F.col("_hot"), "left_anti")
    return rows.join(few, match).unionByName(rest.join(table, match))


def components(links: DataFrame, scratch: Scratch, most_links: int | None = None) -> DataFrame:
    """node and root (the smallest node reachable) of every node in ``links(a, b)``.

    Each round gives every node the smallest label among its neighbours' and its
    own, then follows labels once more, so that chains shorten by halves. Rounds end
    when no label changes. Minima combine map-side, so a node with very many links
    sends one row per task. Loops and repeated links do no harm; no links, no rows.
    ``most_links`` bounds the number of links, if it is known.
    """
    both = scratch.table(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
        None if most_links is None else 2 * most_links,
    )
    n = both.count()
    labels = scratch.table(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels", n
    )
    nodes = labels.count()
    while True:
        seen = labels.select(F.col("node").alias("_b"), F.col("root").alias("_r"))
        near = join_hot(both, "b", seen, "_b", n).groupBy(F.col("a").alias("node")).agg(F.min("_r").alias("_near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "_near").alias("_new"))
        step = scratch.table(step, "steps", n)
        roots = labels.select(F.col("node").alias("_via"), F.col("root").alias("_up"))
        step_up = join_hot(step, "_new", roots, "_via", nodes).select(
            "node", F.least("_new", "_up").alias("root"), (F.least("_new", "_up") != F.col("root")).alias("moved")
        )
        after = scratch.table(step_up, "labels", n)
        moved = after.where("moved").limit(1).count()
        scratch.drop(labels, step)
        labels = after.drop("moved")
        labels._scratch_path = after._scratch_path
        if not moved:
            scratch.drop(both)
            return labels
