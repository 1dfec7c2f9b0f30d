"""The pipeline from end to end: whole small tables against plain Python, and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_edges import SCHEMA, TEXTS, rows
from tradeweave.llm import toxicity


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def survivors(docs, score):
    """Documents (doc_id -> (source, text)) that the first three stages keep."""
    clean = {i: d for i, d in docs.items() if score(d[1])[0] < 0.5}
    first = {}
    for i in sorted(clean):
        first.setdefault(normal(clean[i][1]), i)
    kept = {i: clean[i] for i in first.values()}
    sets = {i: shingles(t) for i, (_, t) in kept.items()}
    root = {i: i for i in kept}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i: kept[i] for i in kept if root[i] == i}


def copies(docs, weights=(3.0, 1.0, 2.0)):
    """How often systematic sampling takes each document."""
    size = {i: len((t or "").encode().split()) for i, (_, t) in docs.items()}
    words = Counter()
    for i, (s, _) in docs.items():
        words[s] += size[i]
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(words.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2.0 * words[s]}
        for s in full or open_:
            target[s] = 2.0 * words[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    out = Counter()
    for s in order:
        u = int(hashlib.md5(("mix:" + (s if s is not None else "\x00")).encode()).hexdigest()[:3], 16) / 4096
        rate = target[s] / words[s] if words[s] else 0.0
        own = sorted((size[i], i) for i, d in docs.items() if d[0] == s)
        for k, (_, i) in enumerate(own):
            out[i] = math.floor((k + 1) * rate + u) - math.floor(k * rate + u)
    return out


def test_all_stages_equal_plain_python(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = {r["doc_id"]: (r["source"], r["text"]) for r in table.collect()}
    chain = toxicity.learn(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = survivors(docs, toxicity.scorer(chain))
    taken = copies(kept)
    assert len(kept) < len(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    found = Counter()
    for p in pieces:
        ids = np.array(tokenizer.encode(docs[p["doc_id"]][1] or "", add_special_tokens=False).ids + [0], "<u4")
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        found[p["doc_id"]] += p["length"]
    sizes = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert {i: n // sizes[i] for i, n in found.items()} == {i: n for i, n in taken.items() if n}
    assert all(n % sizes[i] == 0 for i, n in found.items())


@pytest.mark.parametrize("kind", ["odd", "repeated", "none"])
def test_stages_on_odd_tables(spark, tmp_path, kind):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, no rows.

    Rows without doc_id are kept by the filters unless a row of their group has one;
    repeated rows count as one text; an empty table gives an empty table.
    """
    given = {"odd": TEXTS, "repeated": [t for t in TEXTS if t[0] != 7 and t[0] != 8] * 3, "none": []}[kind]
    labels = [(1, 0), (4, 0), (None, 1), (6, None)] if given else []
    spark.createDataFrame(rows(given), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        texts = [] if k == 4 else [r["text"] for r in docs.collect()]
        if name == "toxicity":
            assert len(texts) == len(given)
        if name == "exact_dedup":
            assert len(texts) == len({normal(t) for t in texts}) == len({normal(t) for _, t, *_ in given})
    pieces = docs.collect()
    assert bool(pieces) == bool(given)
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
