"""Models and tokenizers against plain Python: every rank, id, checksum and score."""

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tradeweave.llm import language, queries, toxicity


def grams(text):
    """Counts of the 1- to 3-grams of letters, words bounded by one space."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = " " + " ".join(letters.split()) + " "
    if not s.strip():
        return Counter()
    found = Counter(c for c in s if c != " ")
    found.update(a + b for a, b in zip(s, s[1:]) if (a, b) != (" ", " "))
    found.update(a + b + c for a, b, c in zip(s, s[1:], s[2:]) if b != " ")
    return found


def code(gram):
    out = 0
    for c in gram:
        out = (out << 21) | ord(c)
    return out


def ranked(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:most]


@pytest.mark.parametrize("cut", [3, 5, 64, language.SLICE])
def test_grams_do_not_depend_on_slices(monkeypatch, cut):
    monkeypatch.setattr(language, "SLICE", cut)
    for text in (None, "", " ", "a", "1", "ab", " a b ", "Ünder  den 7 Brücken", "x\n\ny", "abc" * 9 + " 1 " * 4, "ends here!  "):
        codes, counts = language.gram_counts(text)
        want = grams(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in want.items()}, text


def test_language_equals_plain_out_of_place_distance(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d in docs}
    counts = {}
    for d in docs:
        if not held[d["doc_id"]] and d["lang"] is not None:
            counts.setdefault(d["lang"], Counter()).update(grams(d["text"]))
    known = {lang: {g: i for i, g in enumerate(ranked(c, language.PROFILE))} for lang, c in sorted(counts.items())}
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_language"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, own = got[d["doc_id"]], ranked(grams(d["text"]), language.DOC_GRAMS)
        assert r["held_out"] == held[d["doc_id"]]
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        miss = language.PROFILE
        far = {lang: sum(min(abs(ranks[g] - i), miss) if g in ranks else miss for i, g in enumerate(own)) / len(own) for lang, ranks in known.items()}
        best, second = sorted(far, key=lambda k: (far[k], k))[:2]
        assert r["lang_pred"] == best and r["score"] == pytest.approx(far[second] / (far[best] + far[second]) if far[second] else 0.5)


def encoded(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing_query_holds_every_id_once(spark):
    ids = encoded("byte_bpe_50k.json", 0)
    want = {r["doc_id"]: ids(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    pieces = queries.QUERIES["op4_packing"](spark, SMALL).collect()
    by_doc, sequences = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert by_doc.keys() == want.keys()
    for doc_id, own in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(own):
            assert (start, total) == (at, len(want[doc_id])) and crc == zlib.crc32(want[doc_id][start : start + length].tobytes())
            at += length
        assert at == len(want[doc_id])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(map(len, want.values()))
    assert 1024 * len(sequences) < 1.05 * tokens


def test_token_files_query_equals_the_library(spark):
    ids = encoded("word_bpe_49k.json", 1)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for doc_id, text in docs:
        own = ids(text)
        want.append((doc_id, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    got = queries.QUERIES["op6_token_files"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def log_z(e, step):
    """Log of the sum over all labellings of one window."""
    total = 0.0
    for y in itertools.product((0, 1), repeat=len(e)):
        total += np.exp(sum(w for w, label in zip(e, y) if label) + sum(step[a][b] for a, b in zip(y, y[1:])))
    return np.log(total)


def test_forward_backward_is_the_gradient_of_all_labellings():
    rng = np.random.default_rng(4)
    h = 1e-5
    for n in (1, 2, 5, 8):
        e, step = rng.normal(size=n), rng.normal(size=(2, 2))
        p, counts = toxicity._forward_backward(np.pad(e, (0, 3))[None], np.array([n]), step)
        for t in range(n):
            up, down = e.copy(), e.copy()
            up[t] += h
            down[t] -= h
            assert p[0, t] == pytest.approx((log_z(up, step) - log_z(down, step)) / (2 * h), abs=1e-6)
        for i, j in itertools.product((0, 1), repeat=2):
            up, down = step.copy(), step.copy()
            up[i, j] += h
            down[i, j] -= h
            assert counts[i, j] == pytest.approx((log_z(e, up) - log_z(e, down)) / (2 * h), abs=1e-6)


def test_document_scores_equal_a_full_pass_over_all_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    chain = toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op5_toxicity"](spark, SMALL).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        words = toxicity._WORD.findall(text or "")
        weights = [chain.weight(w) for w in words]
        if any(weights):
            e = np.array([[chain.bias + w for w in weights]])
            p = toxicity._forward_backward(e, np.array([len(words)]), np.array(chain.step))[0][0]
            near = {i for i, _ in chain.marginals([(i, w) for i, w in enumerate(weights) if w], len(words))}
            # what is skipped is far from any weighted word, and faint
            marginals = [(i, float(x)) for i, x in enumerate(p) if i in near or x >= toxicity.FAINT]
            assert got[doc_id] == pytest.approx(chain.score(marginals), abs=1e-6)
        else:
            assert got[doc_id] == got.setdefault(None, got[doc_id])
