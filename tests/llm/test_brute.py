"""Queries against plain Python and SQL over whole small tables."""

import duckdb
import pytest

from tests.conftest import SMALL
from tradeweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert set(columns) <= set(df.columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(df.select(*columns).collect()) == plain(result.fetchall())


def test_near_duplicates_equal_all_pairs(spark):
    got = queries.QUERIES["op1_minhash"](spark, SMALL).collect()
    sets = {}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall():
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(d, len(s), root[d]) for d, s in sets.items()}


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    told = queries.QUERIES["op2_language"](spark, base).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in told) > 0.97 * len(told) > 0
    toxic = queries.QUERIES["op5_toxicity"](spark, base).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in toxic) > 0.9 * len(toxic) > 0
