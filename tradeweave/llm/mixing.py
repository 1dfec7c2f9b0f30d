"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source_size`` copies. Documents
are laid out by size, the expected copies are summed along that order, one random
offset is added for the source, and a document is emitted once per integer boundary
that its interval crosses. Order by size keeps the words taken within about one
document of the target.

The running sum needs no task that holds a source: rows are range-sorted, written,
numbered within their partition, and the partitions' counts are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words of a text; a missing one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Words to take per source, from one row (source, source_size) per source.

    Sources in code-point order, missing last, take the weights in turn. They share
    ``share`` of all words; none gets more than ``most`` times its own, and what is
    over is shared again by weight. That is one water level: sources fill in order
    of the level at which they are full. One task handles one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_i", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level)
    # levels rise to the first source that is not full at its own, and fall after it
    open_level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every)
    target = F.least("_cap", F.coalesce(open_level * F.col("_w"), F.col("_cap")))
    return ranked.select("source", "source_size", target.alias("target"))


def offset_of(source: Column, seed: str = SEED) -> Column:
    """The source's random offset: one of 4096 steps of [0, 1)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") / 4096


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Copies of every document: doc_id, size, source, source_size, target, copies.

    Missing and empty texts have size 0 and count as documents of their source.
    A missing source is a source of its own, last in order. Rows without doc_id
    and repeated rows are sampled like any other. No document is emitted more than
    ``ceil(most)`` times; with ``most`` 2, at most twice. Reruns give the same.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), size_of(docs["text"]).alias("size")
    )
    laid = scratch.table(
        rows.repartitionByRange("source", "size", "doc_id")
        .sortWithinPartitions("source", "size", "doc_id")
        .withColumn("_at", F.monotonically_increasing_id()),
        "sorted",
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy("_part", "source").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words")
    )
    runs = scratch.table(runs, "runs")  # a row per partition and source in it
    targets = source_targets(runs.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    runs = (
        runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(t, F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("_part").alias("_p"), F.col("source").alias("_s"), "_first", "_base", "source_size", "target")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    k = F.col("_base") + F.col("_at") - F.col("_first")
    u = offset_of(F.col("source"), seed)
    copies = F.floor((k + 1) * rate + u) - F.floor(k * rate + u)
    return laid.join(runs, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies")
    )


def _row_key(doc_id, size, source) -> Column:
    """Document, size and source as one text; missing ones have a spelling of their own.

    A plain key on both sides: join and window then use one and the same shuffle.
    """
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("-")) for c in (doc_id, size)]
    name = F.col(source) if isinstance(source, str) else source
    return F.concat(parts[0], F.lit(","), parts[1], F.coalesce(F.concat(F.lit(",="), name), F.lit(",-")))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """Every row as often as the mix takes it, with all its columns."""
    mixed = mix(docs, **settings)
    mixed = mixed.select(_row_key("doc_id", "size", "source").alias("_a"), "copies").groupBy("_a").agg(F.array_sort(F.collect_list("copies")).alias("_all"))
    mixed = mixed.where(F.element_at("_all", -1) > 0)
    own = _row_key(docs["doc_id"], size_of(docs["text"]), docs["source"])
    whole = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(own.alias("_b"), whole.alias("_doc")).join(mixed, F.col("_a") == F.col("_b"))
    # rows alike in id, source and size are told apart by their place; the join has dealt them out
    place = F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("_doc")))
    taken = rows.withColumn("copies", F.element_at("_all", place.cast("int"))).where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def op3_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM r WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(lev) FROM l WHERE lev * w <= cap) * w, cap)) AS target FROM l
), n AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.source, chr(0))), 1, 3))::INTEGER / 4096.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(k * rate + u) - floor((k - 1) * rate + u)) * size)::BIGINT AS taken FROM n
"""
