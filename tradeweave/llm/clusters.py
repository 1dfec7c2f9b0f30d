"""Centroid clustering with integer vectors and an equal-average equal-variance search.

Centroids stand in order of their component sums. A vector meets them outward from its
own sum: the squared distance is at least the squared difference of the sums over the
number of components, so the first centroid that this rules out ends the scan. Others
are ruled out by the same bound plus the squared difference of the deviations. What
remains is decided by the exact integer distance. Bounds are compared with a margin
above their rounding error, so no centroid is ruled out that could win or tie.

A round reads the vectors once; tasks add up integers per cluster, and the driver gets
one sum per cluster and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch
from tradeweave.llm.tasks import bounded

SIZE = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = "2:"
#: Components from here on have squared distances beyond a long integer.
BEYOND = float(1 << 27) / SCALE
_NONE = np.iinfo(np.int64).max


class Searcher:
    """The nearest of a few integer centroids, by squared Euclidean distance; ties go to
    the smaller number."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.centroids = centroids[self.number]
        self.sums = sums[self.number]
        self.spread = self._spread(self.centroids, self.sums)
        #: Exact distances taken; for tests.
        self.finished = 0

    @staticmethod
    def _spread(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Deviation from the own mean, times the root of the number of components."""
        k = x.shape[1]
        return np.sqrt(((k * x - sums[:, None]).astype(np.float64) ** 2).sum(axis=1) / k)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every row."""
        n, k = len(x), len(self.sums)
        best, cluster = np.full(n, _NONE), np.zeros(n, np.int64)
        sums = x.sum(axis=1)
        spread = self._spread(x, sums)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        active = np.arange(n)
        while len(active):
            lo, hi, s = low[active], high[active], sums[active]
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], _NONE)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, _NONE)
            down = below <= above
            apart = np.minimum(below, above)
            limit = x.shape[1] * best[active].astype(np.float64) * (1 + 1e-9)
            mean_bound = apart.astype(np.float64) ** 2
            open_ = (apart != _NONE) & (mean_bound <= limit)
            active, down, mean_bound, limit = active[open_], down[open_], mean_bound[open_], limit[open_]
            at = np.where(down, low[active], high[active])
            low[active[down]] -= 1
            high[active[~down]] += 1
            gap = np.abs(spread[active] - self.spread[at]) - 1e-9 * (spread[active] + self.spread[at])
            near = mean_bound + np.maximum(gap, 0.0) ** 2 <= limit
            rows, at = active[near], at[near]
            apart = x[rows] - self.centroids[at]
            distance = (apart * apart).sum(axis=1)
            self.finished += len(rows)
            number = self.number[at]
            wins = (distance < best[rows]) | ((distance == best[rows]) & (number < cluster[rows]))
            best[rows[wins]], cluster[rows[wins]] = distance[wins], number[wins]
        return cluster, best


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _sums(centroids: np.ndarray):
    """Rows and component sums per cluster, added up over a task."""

    def sums(batches):
        searcher = Searcher(centroids)
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros_like(centroids)
        for batch in batches:
            x = _matrix(batch.column(1), centroids.shape[1])
            cluster, _ = searcher.nearest(x)
            count += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array([[int(count[c]), *total[c].tolist()] for c in used.tolist()], pa.list_(pa.int64())),
            ],
            names=["cluster", "sums"],
        )

    return sums


def _assign(centroids: np.ndarray):
    def assign(batches):
        searcher = Searcher(centroids)
        for batch in batches:
            cluster, distance = searcher.nearest(_matrix(batch.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return assign


def usable(v: Column, size: int = SIZE) -> Column:
    """Exactly ``size`` components, none missing, not finite, or beyond what a long holds."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(BEYOND)))
    return v.isNotNull() & (F.size(v) == size) & fine


def integer_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and the components as integers floor(scale * x) of the usable rows."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("v"))
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    return rows.where(F.coalesce(usable(F.col("v"), size), F.lit(False))).select("vec_id", whole.alias("v"))


def clusters(
    vectors: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    size: int = SIZE,
    seed: str = SEED,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every usable row, and the final centroids.

    Centroids start as the vectors whose ids have the smallest hashes, of one id the
    smallest vector first; with fewer vectors there are fewer of them. Rows without
    vec_id are clustered but start no centroid; rows that repeat one count each.
    A round moves every centroid that has vectors to the floor of their mean. Vectors
    that are missing, of another size, or hold a component that is missing, not
    finite or at least 524288 in size (its squared distances exceed a long) are left
    out. Without any vector with an id there are no centroids and no rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "clusters")
    rows = scratch.table(integer_vectors(vectors, size), "vectors")
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where(F.col("vec_id").isNotNull()).orderBy(digest, "v").limit(centroids).collect()
    middle = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    if not len(middle):
        return rows.where(F.lit(False)).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), middle
    for _ in range(rounds):
        added = rows.mapInArrow(bounded(_sums(middle), rows=8192), "cluster int, sums array<long>")
        added = added.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s"))
        total: dict[int, dict[int, int]] = {}
        for r in added.collect():  # centroids * (size + 1) rows
            total.setdefault(r["cluster"], {})[r["i"]] = r["s"]
        middle = middle.copy()
        for c, s in total.items():
            middle[c] = [s[i + 1] // s[0] for i in range(size)]
    return rows.mapInArrow(bounded(_assign(middle), rows=8192), "vec_id long, cluster int, distance long"), middle


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13_clusters(spark, sf_dir: str) -> DataFrame:
    """Every vector with its cluster, distances and the cluster's centroid."""
    scratch = Scratch(spark, "clusters")
    assigned, middle = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scratch=scratch)
    assigned = scratch.table(assigned, "assigned")
    table = [(c, centroid_digest(m)) for c, m in enumerate(middle)]
    named = spark.createDataFrame(table, "_cluster int, centroid_sha256 string")
    # sums beyond a long integer are missing
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_own"))
    all_ = per.agg(F.sum("_own").alias("_all"))
    per = per.crossJoin(all_).join(named, F.col("cluster") == F.col("_cluster"))  # a row per centroid, and one row
    per = per.select("_cluster", F.col("_own").try_cast("long").alias("cluster_inertia"), F.col("_all").try_cast("long").alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(per), F.col("cluster") == F.col("_cluster")).drop("_cluster")  # at most CENTROIDS rows


def _sql() -> str:
    """The rounds written out one after another."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(x) < {BEYOND}]) = {SIZE}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), v) - 1 AS c, v AS m
  FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}
)""",
    ]
    for k in range(ROUNDS + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT r, c, list_sum([(t[1] - t[2]) * (t[1] - t[2]) FOR t IN list_zip(v, m)])::BIGINT AS d FROM v, c{k}
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""
        )
        if k < ROUNDS:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (
        SELECT a.c, unnest(range({SIZE})) AS i, unnest(v.v) AS x FROM a{k} a JOIN v USING (r)
      ) GROUP BY c, i
    ) GROUP BY c
  ) n USING (c)
)"""
            )
    last = ROUNDS
    return (
        "WITH "
        + ", ".join(parts)
        + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance,
  (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([x::VARCHAR FOR x IN m], ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (r) JOIN c{last} c ON a.c = c.c
"""
    )


SQL = _sql()
