"""Centroid clustering against plain rounds over all distances; SQL is in test_brute."""

import hashlib
import math

import numpy as np

from tests.conftest import SMALL
from tradeweave.llm import clusters, queries

SCHEMA = "cluster int, vec_id long, embedding array<float>, label int, distance string, v int"


def plain(rows, k=40, rounds=5):
    """(vec_id, cluster, distance) of every kept row, and the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 524288 for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle))

    for _ in range(rounds if middle else 0):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else m for c, m in enumerate(middle)]
    return [(i, *reversed(nearest(v))) for i, v in kept] if middle else [], middle


def given():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.3, size=64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [rows[3], rows[3], (None, rows[5][1]), (None, None)]
    bad = list(rows[7][1])
    for x in (None, float("nan"), float("inf"), 1e30):
        rows.append((300, [x, *bad[1:]]))
    rows += [(301, bad[:63]), (302, [*bad, 0.5]), (303, []), (304, None), (305, [0.0] * 64), (306, [500000.0] * 64)]
    return rows


def test_equal_to_plain_rounds(spark):
    rows = given()
    df = spark.createDataFrame([(1, i, v, None, "d", 2) for i, v in rows], SCHEMA)
    want, middle = plain(rows)
    for parts in (1, 7):
        got, centroids = clusters.clusters(df.repartition(parts))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        assert centroids.tolist() == middle


def test_few_or_no_vectors(spark):
    few = given()[:3]
    got, centroids = clusters.clusters(spark.createDataFrame([(1, i, v, None, "d", 2) for i, v in few], SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(plain(few)[0]) and len(centroids) == 3
    for rows in ([], [(None, few[0][1])]):
        got, centroids = clusters.clusters(spark.createDataFrame([(1, i, v, None, "d", 2) for i, v in rows], SCHEMA))
        assert got.collect() == [] and len(centroids) == 0


def test_bounds_rule_out_centroids_and_never_the_nearest():
    rng = np.random.default_rng(2)
    levels = rng.integers(-200, 200, 40)
    middle = levels[:, None] + rng.integers(-30, 31, (40, 64)) * rng.integers(0, 4, 40)[:, None]
    middle[9] = middle[4]
    x = middle[rng.integers(0, 40, 2000)] + rng.integers(-9, 10, (2000, 64))
    search = clusters.Searcher(middle)
    cluster, distance = search.nearest(x)
    all_ = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (cluster == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    assert search.finished < 0.35 * x.shape[0] * len(middle)


def test_query_equals_plain_rounds(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, middle = plain(rows)
    got = queries.QUERIES["op13_clusters"](spark, SMALL).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    total = sum(d for *_, d in want)
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middle[r["cluster"]])).encode()).hexdigest()
