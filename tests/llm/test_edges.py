"""Every operator on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tradeweave.llm import exact_dup, language, licences, mixing, near_dup, packing, simple8b, toxicity, vectors, warc
from tradeweave.llm.scratch import Scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, copies int, _n int, key string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick  brown fox\njumps over the lazy dog", "en", "a"),
    (2, "the quick  brown fox\njumps over the lazy dog", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "  \t\n", "en", "b"),
    (6, "one", "en", None),
    (None, "one", "en", "b"),
    (None, None, None, None),
    (7, LONG, "de", "b"),
    (8, LONG + " tail", "de", "c"),
    (9, "Licensed under the Apache License, Version 2.0.", "en", "c"),
]


def rows(texts):
    return [(i, t, lang, s, len(t or ""), 1, "x", 2, 3, "k") for i, t, lang, s in texts]


@pytest.fixture(params=["some", "none"])
def docs(spark, request):
    return spark.createDataFrame(rows(TEXTS) if request.param == "some" else [], SCHEMA)


def test_near_duplicates(docs):
    out = near_dup.near_duplicates(docs, words=4).collect()
    assert len(out) == docs.count()
    if out:
        by = {r["doc_id"]: r for r in out if r["doc_id"]}
        assert [by[i]["component_id"] for i in (1, 2, 7, 8)] == [1, 1, 7, 7]
        assert [by[i]["n_shingles"] for i in (3, 4, 5, 6)] == [0, 0, 0, 1]
        assert all(by[i]["kept"] for i in (3, 4, 5)) and not by[8]["kept"]
        assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)


def test_exact_duplicates(docs):
    out = exact_dup.duplicate_groups(docs).collect()
    assert len(out) == docs.count()
    if out:
        by = {r["doc_id"]: r for r in out if r["doc_id"]}
        assert by[2]["keep_id"] == 1 and by[2]["group_size"] == 3 and not by[2]["kept"]
        assert by[4]["keep_id"] == 3 and by[5]["group_size"] == 1 and by[6]["group_size"] == 2
        kept = exact_dup.drop_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]
        assert {(r["_n"], r["key"]) for r in kept.collect()} == {(3, "k")}


def test_mixing(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["copies"] <= 2 for r in out)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_targets_fill_to_one_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 5), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights, caps, left = {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 200, "c": 10, None: 2000}, 1.5 * 1115
    want, open_ = {}, set(caps)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > caps[s]}
        for s in full or open_:
            want[s] = caps[s] if full else level * weights[s]
        left -= sum(want[s] for s in full)
        open_ -= full or open_
    assert got == pytest.approx(want)


def test_packing(docs):
    out = packing.pack(docs, BYTES).collect()
    sequences = {}
    tokenizer = Tokenizer.from_file(BYTES)
    whole = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _, _ in TEXTS] if out else []
    assert sum(r["length"] for r in out) == sum(map(len, whole))
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= 1024
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert [o for o, _ in places] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 65, 400)
    place, offset = packing.best_fit_decreasing(lengths, 64)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [r for r in room if r >= lengths[i]]
        best = min(fits) if fits else 64
        if fits:
            room.remove(best)
        room += [best - lengths[i]] if best - lengths[i] else []
        want[i] = 64 - best
    assert [want[i] for i in range(400)] == offset.tolist()
    assert all(lengths[place == w].sum() <= 64 for w in set(place.tolist()))


def test_token_files(spark, docs):
    folder = Scratch(spark, "t").folder("ids")
    simple8b.write_ids(docs, WORDS, folder)
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(
        ((i, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t, _, _ in TEXTS),
        key=str,
    )
    got = sorted(((r["doc_id"], zlib.crc32(r["ids"])) for r in simple8b.read_ids(spark, folder).collect()), key=str)
    assert got == (want if docs.count() else [])


@pytest.mark.parametrize("top", [1, 2, 60_000, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    ids = (rng.random(3000) * top).astype(np.uint64)
    ids[rng.random(3000) < 0.4] = 0
    ids[5:8] = [simple8b.ESCAPE, simple8b.ESCAPE, top]
    content = simple8b.to_file([7], [3000], ids)
    assert (simple8b.from_file(content)[2] == ids).all()
    assert (simple8b.read_block(content, 1) == ids[1024:2048]).all()


def test_language(docs):
    known = language.profiles(docs)
    out = language.identify_languages(docs, known).collect()
    assert len(out) == docs.count()
    if out:
        assert {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5)} == {"und"}
        assert all(0 <= r["score"] <= 1 for r in out)
        assert {r["lang_pred"] for r in out if r["doc_id"] in (7, 8)} == {"de"}


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, "x"), (2, None, "y"), (None, 1, "z")], "doc_id long, toxic int, text string")
    chain = toxicity.learn(docs, labels)
    out = toxicity.score_toxicity(docs, chain).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] < 0.5 for r in out)
    assert toxicity.reject_toxic(docs, chain).columns == docs.columns


def test_toxic_spans_are_learned(spark):
    clean, bad = "some words of a plain text number {}", "some words you awful{} person of text number {}"
    texts = [(i, bad.format("ly", i) if i % 5 == 0 else clean.format(i), int(i % 5 == 0)) for i in range(300)]
    known = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    chain = toxicity.train(known)
    score = toxicity.scorer(chain)
    high, spans = score("a plain text, you awfully odd text")
    assert high >= 0.5 and "awfully" in " ".join("a plain text, you awfully odd text"[a:b] for a, b, _ in spans)
    assert score("a plain text of words")[0] < 0.5


def test_marginals_equal_a_full_sweep():
    chain = toxicity.Chain(words={"bad": 6.0, "odd": 2.0})
    tokens = ["x"] * 7 + ["bad", "odd"] + ["x"] * 90 + ["bad"] + ["x"] * 5
    weights = [(i, chain.weight(t)) for i, t in enumerate(tokens) if chain.weight(t)]
    near = dict(chain.marginals(weights, len(tokens)))
    e = np.array([[chain.bias + chain.weight(t) for t in tokens]])
    full, _ = toxicity._forward_backward(e, np.array([len(tokens)]), np.array(chain.step))
    assert max(abs(p - full[0, i]) for i, p in near.items()) < 1e-6


def test_archives(spark, tmp_path):
    page = "<p>" + "x" * 200
    pages = [(1, "http://a", page, "q"), (2, None, page, "q"), (2, "http://b c\n", page, "q"), (3, "u", None, "q"), (None, None, "", "q"), (None, "n", page, "q")]
    for given in (pages, []):
        df = spark.createDataFrame(given, "page_id long, url string, html string, digest string")
        folder = Scratch(spark, "w").folder("warc")
        warc.write_archives(df, folder, file_bytes=700)
        out = warc.read_archives(spark, folder).collect()
        assert len(out) == len(given)
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    names = []
    for _ in range(2):
        folder = Scratch(spark, "w").folder("warc")
        names.append(sorted(tuple(r) for r in warc.write_archives(df, folder, file_bytes=700).collect()))
        out = warc.read_archives(spark, folder).collect()
    assert names[0] == names[1] and len(names[0]) > 1
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out} == {
        (1, "response", None), (2, "revisit", 1), (3, "response", None), (None, "response", None), (None, "revisit", 1)
    }


def test_vectors(spark):
    inf = float("inf")
    data = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.01], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [0.0, 0.0], 0),
        (7, [float("nan"), 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, None], 0), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 0),
        (11, [2e30, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [], 0),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    alone = {i: (0, i) for i in (5, 6, 7, 8, 9, 10, 12, 13)}
    assert got == alone | {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 11: (1, 4), None: (0, None)}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_across_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 8)), 4, axis=0) + 0.12 * rng.normal(size=(240, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (np.arange(240)[:, None] % 2 == np.arange(240) % 2) & ~np.eye(240, dtype=bool)
    root = np.arange(240)
    for _ in range(240):
        root = np.array([min(root[i], *root[linked[i]]) if linked[i].any() else root[i] for i in range(240)])
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect())
    assert got == [(i, int(linked[i].sum()), int(root[i])) for i in range(240)]


def test_licences(docs):
    out = licences.licences(docs).collect()
    assert len(out) == docs.count()
    if out:
        assert {r["doc_id"]: r["licences"] for r in out if r["licences"]} == {9: ["Apache-2.0"]}


def test_licence_rules_need_their_sentences_in_order(spark):
    notice = "The above copyright notice and this permission notice shall be included in all copies."
    grant = "Permission is hereby granted, free of charge, to any person\n// obtaining a copy of this software."
    later = "This work is licensed under the GNU General Public License, version 3, or (at your option) any later version."
    texts = [(1, f"// {grant}\n// {notice}"), (2, f"{notice} {grant}"), (3, "Released under the MIT license"), (4, later), (5, "A licence of my own.")]
    out = {r["doc_id"]: r for r in licences.licences(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [out[i]["licences"] for i in range(1, 6)] == [["MIT"], [], ["MIT"], ["GPL-3.0-or-later"], []]
    assert out[5]["n_unknown"] == 1


def test_licence_rules_on_long_sequences(spark):
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted. "
    source = "Redistributions of source code must retain the above copyright notice. "
    binary = "Redistributions in binary form must reproduce the above copyright notice. "
    texts = [(1, (grant + source) * 3000), (2, (grant + source) * 3000 + binary), (3, binary + source + grant), (4, grant + source + "Copyright 2020. " + binary)]
    out = {r["doc_id"]: r for r in licences.licences(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [out[i]["licences"] for i in (1, 2, 3, 4)] == [[], ["BSD-2-Clause"], [], ["BSD-2-Clause"]]
    assert out[2]["n_sentences"] == 6001


def test_pipeline_stages_pass_on_documents(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, base).columns == docs.columns, name
    packed = corpus_pipeline.run(spark, base)
    assert packed.select(F.sum("length")).first()[0] > 0


def test_shards_are_bounded_whatever_the_ids(spark):
    body = lambda k: f"{k} " + "x" * 900
    outlier = [(i, "u", body(i)) for i in range(300)] + [(10**15, "u", body("far")), (-(10**12), "u", body("near"))]
    nameless = [(None, "u", body(i)) for i in range(300)]
    one = [(7, "u", body(i)) for i in range(300)]
    for rows in (outlier, nameless, one):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        manifests = []
        for parts in (1, 6):
            folder = Scratch(spark, "w").folder("warc")
            listed = warc.write_archives(df.repartition(parts), folder, shard_bytes=30_000).collect()
            manifests.append(sorted(tuple(r) for r in listed))
            out = warc.read_archives(spark, folder).collect()
            assert sorted((r["page_id"] or -1, r["payload"].decode()) for r in out) == sorted((i or -1, t) for i, _, t in rows)
        assert manifests[0] == manifests[1]
        records = [r[1] for r in manifests[0]]
        assert len(records) >= 10 and max(records) <= 30_000 // 1300 + 2, records


def test_record_ids_are_unique(spark):
    rows = [(1, "u", "a" * 200), (1, "u", "a" * 200), (1, "u", "b" * 200), (None, "u", "c"), (None, "u", "d"), (2, "u", "a" * 200)]
    folder = Scratch(spark, "w").folder("warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).collect()
    ids = [h["warc-record-id"] for f in files for h, _ in warc.records(f["content"])]
    assert len(ids) == len(set(ids)) == len(rows) + len(files)
