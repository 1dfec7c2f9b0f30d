"""Bounds that keep vectors apart lose no link."""

import numpy as np
import pyarrow as pa
import pytest

from tradeweave.llm import vectors

REACH = float(np.sqrt(2 - 2 * vectors.COSINE)) + 1e-7


def around(centres, each, spread, seed=5, size=6):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(centres, size)), each, axis=0) + spread * rng.normal(size=(centres * each, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_no_neighbour_lies_beyond_the_plane_between_pivots():
    x = around(80, 5, 0.15)
    pivots = np.concatenate([x[::40], x[:1]])  # two pivots coincide
    d = vectors._distances(x, pivots)
    own = d.argmin(axis=1)
    beyond = vectors._beyond(d, own, vectors._distances(pivots, pivots), REACH)
    linked = x @ x.T >= vectors.COSINE
    assert beyond.any() and linked.sum() > len(x)
    for c in range(len(pivots)):
        assert not linked[np.ix_(beyond[:, c], own == c)].any()


@pytest.mark.parametrize("strip", [1, 7, 512])
def test_strips_find_every_link_of_a_block(monkeypatch, strip):
    monkeypatch.setattr(vectors, "STRIP", strip)
    x = around(60, 4, 0.12)
    far = vectors._distances(x, x[:1])[:, 0]
    n = len(x)
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 4, n)
    both = np.concatenate([rng.permutation(n), rng.permutation(n)])
    table = pa.table(
        {
            "node": pa.array(both),
            "weight": pa.array(weight[both]),
            "embedding": pa.array((x * rng.uniform(0.1, 9, n)[:, None])[both].tolist()),
            "far": pa.array(far[both]),
            "asks": pa.array([True] * n + [False] * n),
        }
    )
    got = vectors._compare(vectors.COSINE, REACH)(table).to_pylist()
    linked = (x @ x.T >= vectors.COSINE) & ~np.eye(n, dtype=bool)
    counts = np.zeros(n, int)
    for r in got:
        counts[r["a"]] += r["n"]
    assert counts.tolist() == (linked @ weight).tolist()

    def parts(edges):
        root = list(range(n))
        for _ in range(n):
            before = list(root)
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
            if before == root:
                return root

    assert parts([(r["a"], r["b"]) for r in got]) == parts(np.argwhere(linked).tolist())


def test_strips_leave_far_vectors_out():
    far = np.linspace(0, 2, 4000)
    met = sum((s.stop - s.start) * (o.stop - o.start) for s, o in vectors._strips(far, far, REACH))
    assert met < 0.6 * 4000 * 4000
