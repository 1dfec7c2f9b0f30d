"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step only looks at groups that the step before left with more than one row.
Lengths and prefix hashes are counted map-side before the shuffle; the full hash is
taken only of texts whose length and prefix are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; missing is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _shared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Lengths and prefixes (_l, _p) that more than one of the rows has.

    Counts per length and prefix serve both steps: they sum to counts per length.
    """
    counts = scratch.table(rows.groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_n")), "counts")
    lengths = counts.groupBy("_length").agg(F.sum("_n").alias("_of_length")).where("_of_length > 1")
    shared = (
        counts.where("_n > 1")
        .join(lengths.select(F.col("_length").alias("_l")), F.col("_length") == F.col("_l"), "left_semi")
        .select(F.col("_length").alias("_l"), F.col("_prefix").alias("_p"), F.lit(True).alias("_shared"))
    )
    return scratch.table(shared, "shared", counts.count())


def _measured(text: Column) -> list[Column]:
    text = normalised(text)
    return [F.octet_length(text).alias("_length"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("_prefix")]


def duplicate_groups(docs: DataFrame, with_hash: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_hash of every row.

    Texts are equal when their normalised forms are. The row with the smallest
    doc_id of a group stays; a row without doc_id gives way to any other, and a
    group of such rows has no keep_id and stays. Repeated rows of one doc_id count
    as rows and share its fate. ``text_hash`` is missing for texts that no other
    text could equal, unless ``with_hash`` asks for it everywhere; it is then taken
    while the texts are read, and no text is shuffled. Empty and missing texts form
    one group.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    met = (F.col("_length") == F.col("_l")) & (F.col("_prefix") == F.col("_p"))
    if with_hash:
        full = sha256(normalised(docs["text"])).alias("text_hash")
        rows = scratch.table(docs.select(docs["doc_id"].alias("doc_id"), *_measured(docs["text"]), full), "measured")
        hashed = rows.join(_shared(rows, scratch), met, "left").withColumn("_shared", F.col("_shared").isNotNull())
    else:
        rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("_text"), *_measured(docs["text"]))
        found = rows.join(_shared(rows, scratch), met, "left").select(
            "doc_id", "_length", "_prefix", F.col("_shared").isNotNull().alias("_shared"),
            F.when(F.col("_shared"), sha256(normalised(F.col("_text")))).alias("text_hash"),
        )
        hashed = scratch.table(found, "hashed")
    groups = (
        hashed.where("_shared")
        .groupBy("_length", "_prefix", "text_hash")
        .agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
        .select(F.col("text_hash").alias("_hash"), "_keep", "_size")
    )
    out = hashed.join(groups, F.col("_shared") & (F.col("text_hash") == F.col("_hash")), "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_hash",
    )


def drop_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    The row with the smallest doc_id stays, of several the one with the smallest hash
    over all columns, so that reruns agree; rows without doc_id stay only where no row
    of their group has one. Full hashes are taken only of texts whose length and
    prefix another row shares; all other rows pass as they are read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    whole = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(whole.alias("_doc"), docs["doc_id"].alias("_id"), docs["text"].alias("_text"), *_measured(docs["text"]))
    shared = _shared(docs.select(*_measured(docs["text"])), scratch)
    met = (F.col("_length") == F.col("_l")) & (F.col("_prefix") == F.col("_p"))
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.xxhash64("_doc").alias("row"))
    rows = rows.join(shared, met, "left").select(
        "_doc", F.when(F.col("_shared"), sha256(normalised(F.col("_text")))).alias("_hash"),
        F.when(F.col("_shared"), place).alias("_place"),
    )
    rows = scratch.table(rows, "rows")  # texts move once, or not at all where what is shared is small
    alone, hashed = rows.where("_hash is null").select("_doc"), rows.where("_hash is not null")
    first = scratch.table(hashed.groupBy("_hash").agg(F.min("_place").alias("_first")), "first")
    first = first.select(F.col("_hash").alias("_h"), F.col("_first.none").alias("_none"), F.col("_first.id").alias("_least"), F.col("_first.row").alias("_row"))
    is_first = (
        (F.col("_hash") == F.col("_h"))
        & F.col("_place.id").eqNullSafe(F.col("_least"))
        & (F.col("_place.row") == F.col("_row"))
    )
    # rows alike in every column: any of them
    stay = hashed.join(first, is_first, "left_semi").groupBy("_hash").agg(F.first("_doc").alias("_doc")).select("_doc")
    return alone.unionByName(stay).select("_doc.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_groups(docs, with_hash=True).withColumnRenamed("text_hash", "text_sha256")


SQL = f"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
