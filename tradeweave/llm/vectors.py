"""Near-dedup of embeddings: an exact metric range join by pivots.

Unit vectors are as far apart as their cosine tells. Every vector of a label belongs
to the cell of its nearest pivot; it is also sent to each further cell that, by the
triangle inequality, may hold a vector within reach. So all neighbours of a vector
are in its own cell, cells join apart from each other, and every vector's links are
counted there. Cells are cut into blocks, so that no task holds a cell, and blocks
send on trees of links, not pairs. Two bounds keep vectors apart without comparing
them: a vector is not sent across the plane between two pivots when it lies further
than the reach from it, and inside a block, in order of distance to the pivot, only
vectors whose distances differ by no more than the reach are multiplied.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.graph import components
from tradeweave.llm.scratch import Scratch

COSINE = 0.93
BLOCK = 4096
#: Asking vectors of a block, in order of distance, that are multiplied at once.
STRIP = 512
#: Vectors per cell aimed at, more when that would take more than MOST_PIVOTS.
CELL = 4096
MOST_PIVOTS = 4096


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _unit(column) -> np.ndarray:
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def _beyond(d: np.ndarray, own: np.ndarray, gaps: np.ndarray, reach: float) -> np.ndarray:
    """Whether a vector is further than ``reach`` from the half space of each cell.

    The half space of those nearer to a cell's pivot than to the own one ends at the
    plane between the two. Pivots that nearly coincide decide nothing.
    """
    gap = gaps[own]
    nearest = d[np.arange(len(own)), own][:, None]
    return (gap > 1e-3) & (d * d - nearest * nearest > 2 * reach * gap)


def _assign(pivots: dict[tuple[int, int], np.ndarray], reach: float, radius: dict | None):
    """Cells of vectors: the own one only, or with ``radius`` all that may hold neighbours.

    With them goes the distance to the cell's pivot, 0 where a label has no pivots.
    """
    gaps = {key: _distances(p, p) for key, p in pivots.items()} if radius is not None else {}

    def assign(batches):
        for batch in batches:
            labels, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cell = np.full(batch.num_rows, 0, np.int32)
            far = np.zeros(batch.num_rows)
            rows, cells, fars = [], [], []
            for key in {*zip(labels.tolist(), sizes.tolist(), strict=True)} & pivots.keys():
                these = np.flatnonzero((labels == key[0]) & (sizes == key[1]))
                d = _distances(_unit(batch.column(4).take(pa.array(these))), pivots[key])
                own = d.argmin(axis=1)
                cell[these], far[these] = own, d[np.arange(len(own)), own]
                if radius is not None:
                    limit = np.array([radius.get((*key, c), -9.0) for c in range(len(pivots[key]))])
                    near = (d <= limit[None, :] + reach) & (d - far[these][:, None] <= 2 * reach)
                    near &= ~_beyond(d, own, gaps[key], reach)
                    near[np.arange(len(own)), own] = False
                    i, c = np.nonzero(near)
                    rows.append(these[i])
                    cells.append(c)
                    fars.append(d[i, c])
            base = pa.Table.from_batches([batch])
            if radius is None:
                out = base.append_column("cell", pa.array(cell)).append_column("far", pa.array(far))
            else:
                more = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                other = np.concatenate(cells) if cells else np.zeros(0, np.int64)
                away = np.concatenate([far, *fars])
                take = np.concatenate([np.arange(len(cell)), more])
                out = base.take(pa.array(take)).append_column("cell", pa.array(np.concatenate([cell, other]).astype(np.int32)))
                out = out.append_column("far", pa.array(away))
                out = out.append_column("own", pa.array([True] * len(cell) + [False] * len(more)))
            yield from out.to_batches()

    return assign


def _strips(far: np.ndarray, others: np.ndarray, reach: float):
    """Strips of asking vectors, each with the range of others within reach of it.

    Both sides are distances to one pivot, in order. Vectors whose distances differ by
    more than ``reach`` cannot be within it.
    """
    for start in range(0, len(far), STRIP):
        end = min(start + STRIP, len(far))
        low = int(np.searchsorted(others, far[start] - reach, "left"))
        high = int(np.searchsorted(others, far[end - 1] + reach, "right"))
        yield slice(start, end), slice(low, high)


def _compare(least: float, reach: float):
    """Links between the own vectors of one block and the vectors of another."""

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        column = table.column("embedding").combine_chunks()
        raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), -1)
        norm = np.sqrt((raw * raw).sum(axis=1))
        if not (np.isfinite(norm).all() and norm.all()):
            raw = _unit(column)
            norm = np.ones(len(node))
        far = table.column("far").to_numpy()
        order = np.argsort(far, kind="stable")
        q, c = order[asks[order]], order[~asks[order]]
        linked = np.zeros((len(q), len(c)), bool)
        others, other_norm = raw[c], norm[c]
        for strip, near in _strips(far[q], far[c], reach):
            products = raw[q[strip]] @ others[near].T
            linked[strip, near] = products / (norm[q[strip]][:, None] * other_norm[None, near]) >= least
        linked &= node[q][:, None] != node[c][None, :]
        count = linked @ weight[c]
        root = np.full(len(q), -1, np.int64)
        a, b = [], []
        waiting = count > 0
        while waiting.any():
            first = int(waiting.argmax())
            mine, frontier = np.zeros(len(q), bool), np.array([first])
            reached = np.zeros(len(c), bool)
            while len(frontier):
                mine[frontier] = True
                new = linked[frontier].any(axis=0) & ~reached
                reached |= new
                frontier = np.flatnonzero(linked[:, new].any(axis=1) & ~mine) if new.any() else np.zeros(0, int)
            waiting &= ~mine
            root[mine] = node[q[first]]
            b.extend(node[c[reached]].tolist())
            a.extend([int(node[q[first]])] * int(reached.sum()))
        has = count > 0
        return pa.table(
            {
                "a": pa.array(np.concatenate([node[q][has], np.array(a, np.int64)])),
                "b": pa.array(np.concatenate([root[has], np.array(b, np.int64)])),
                "n": pa.array(np.concatenate([count[has], np.zeros(len(a), np.int64)]).astype(np.int64)),
            }
        )

    return compare


def near_vectors(vectors: DataFrame, cosine: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Rows link when their labels are equal and not missing, their vectors have the
    same length, and the cosine in double precision reaches ``cosine``. Vectors that
    are missing, empty, zero, or hold a missing or non-finite component link with
    nothing; so do rows without vec_id, which have no component_id and are kept.
    Equal vectors are compared once and counted as often as they occur. vec_id names
    a vector; rows that repeat one share its links.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "vectors")
    spark = vectors.sparkSession
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        vectors["label"].cast("int").alias("label"),
        vectors["embedding"].alias("embedding"),
    )
    fine = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding")))
    distinct = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    distinct = scratch.table(
        distinct.select("node", "label", F.size("embedding").alias("size"), "weight", "embedding"), "distinct"
    )
    # pivots for labels too large for one cell: bounded in number, chosen by hash
    total = distinct.count()
    cell = max(CELL, 2 * -(-total // MOST_PIVOTS))
    large = {
        (r["label"], r["size"]): r["n"]
        for r in distinct.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).collect()
    }
    pivots: dict[tuple[int, int], np.ndarray] = {}
    if large:
        table = spark.createDataFrame([(k[0], k[1], 2.0 * math.ceil(n / cell) / n) for k, n in large.items()], "label int, size int, part double")
        drawn = distinct.join(F.broadcast(table), ["label", "size"])  # at most MOST_PIVOTS rows
        place = F.pmod(F.xxhash64("label", "embedding"), F.lit(1 << 30)) / float(1 << 30)
        found = drawn.withColumn("place", place).where(F.col("place") < F.col("part")).orderBy("place", "node").collect()
        for key, n in large.items():
            own = [r["embedding"] for r in found if (r["label"], r["size"]) == key][: math.ceil(n / cell)]
            if own:
                pivots[key] = _unit(pa.array(own, pa.list_(pa.float64())))
    reach = math.sqrt(2 - 2 * cosine) + 1e-7
    kind = f"node long, label int, size int, weight long, embedding {dict(distinct.dtypes)['embedding']}"
    radius = {}
    if pivots:
        own = distinct.mapInArrow(_assign(pivots, reach, None), f"{kind}, cell int, far double")
        for r in own.groupBy("label", "size", "cell").agg(F.max("far").alias("r")).collect():  # a row per pivot
            radius[(r["label"], r["size"], r["cell"])] = r["r"]
    sent = scratch.table(distinct.mapInArrow(_assign(pivots, reach, radius), f"{kind}, cell int, far double, own boolean"), "cells")
    keys = ["label", "size", "cell"]
    blocks = sent.groupBy(*keys).agg(
        F.ceil(F.sum(F.col("own").cast("long")) / BLOCK).cast("int").alias("asking"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("asked"),
    )
    placed = sent.join(blocks, keys)
    ask = placed.where("own").select(
        *keys, "node", "weight", "embedding", "far", F.lit(True).alias("asks"),
        F.pmod(F.xxhash64("node"), "asking").cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("cb"),
    )
    asked = placed.where("asking > 0").select(
        *keys, "node", "weight", "embedding", "far", F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("qb"),
        F.pmod(F.xxhash64("node"), "asked").cast("int").alias("cb"),
    )
    found = scratch.table(
        ask.unionByName(asked).groupBy(*keys, "qb", "cb").applyInArrow(_compare(cosine, reach), "a long, b long, n long"), "found"
    )
    counts = found.where("n > 0").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_n"))
    roots = components(found.where("a != b").select("a", "b"), scratch)
    scratch.drop(sent)
    known = (
        distinct.select("node", "label", "embedding", "weight")
        .join(counts, F.col("node") == F.col("_node"), "left")
        .join(roots.select(F.col("node").alias("_r"), "root"), F.col("node") == F.col("_r"), "left")
        .select(
            F.col("label").alias("_label"),
            F.col("embedding").alias("_embedding"),
            (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("_links"),
            F.coalesce("root", "node").alias("_component"),
        )
    )
    out = rows.join(
        known,
        (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("vec_id").isNotNull(),
        "left",
    )
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
