"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import pytest

from tests.conftest import SMALL
from tradeweave.llm import queries, runs

SCHEMA = "key string, doc_id long, text string, words int, runs int, start string, fragments int"


def all_runs(words):
    """(start, length, smallest period) of every run, by comparing all pairs of words."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start >= max(q, 12 - q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts():
    rng = random.Random(7)
    out = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 5 + "a y", " ".join(fibonacci(400))]
    for n in (60, 200, 700, 1500):
        for letters in (2, 40, 5000):
            words = [f"w{rng.randrange(letters)}" for _ in range(n)]
            start, period = rng.randrange(n // 2), 1 + rng.randrange(n // 4)
            out.append(" ".join(words))
            out.append(" ".join(w if i < start else words[start + (i - start) % period] for i, w in enumerate(words)))
    return out


def test_equal_to_all_periods(spark):
    given = [("k", i, t, 1, 2, "s", 3) for i, t in enumerate(texts())] + [("k", None, "a b " * 9, 1, 2, "s", 3)]
    given += [given[7], given[7]]
    got = runs.periodic_runs(spark.createDataFrame(given, SCHEMA)).collect()
    assert len(got) == len(given)
    want = sorted(repr((i, all_runs((t or "").split()))) for _, i, t, *_ in given)
    assert sorted(repr((r["doc_id"], [(x["start"], x["length"], x["period"]) for x in r["runs"]])) for r in got) == want
    for r in got:
        words = (dict((g[1], g[2]) for g in given)[r["doc_id"]] or "").split()
        assert r["n_words"] == len(words) and r["collapsed"] == collapsed(words, all_runs(words))


def test_any_cut_into_partitions_gives_the_same(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    one = {r["doc_id"]: r for r in runs.periodic_runs(docs.repartition(1), digest=True).collect()}
    many = {r["doc_id"]: r for r in runs.periodic_runs(docs.repartition(9), digest=True).collect()}
    assert one == many


def test_a_very_long_text_takes_time_in_proportion():
    assert runs.fragments([[b"a"] * 300_000])[0] == [(1, 0, 299_999)]
    block = [b"%d" % (i * i % 7919) for i in range(40_000)]
    found = runs.fragments([block * 5])[0]
    assert {q for q, _, _ in found} >= {40_000}
    assert min(s for q, s, _ in found if q == 40_000) == 0 and max(e for q, _, e in found if q == 40_000) == 160_000


def test_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture(scope="module")
def answer(spark):
    return {r["doc_id"]: r for r in queries.QUERIES["op12_runs"](spark, SMALL).collect()}


def test_query_equals_all_periods(spark, answer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(answer)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    planted = 0
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 3000:
            continue  # the plain search takes the square of the words
        found = all_runs(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (
            len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted((s, m, q) for s, m, q in found))), sha(collapsed(words, found)),
        )
        r = answer[doc_id]
        assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
    assert planted > 5
