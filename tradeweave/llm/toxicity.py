"""Toxic spans by a linear-chain conditional random field.

Labels say which documents are toxic, not where. Words that mark the toxic ones,
by their document counts, label the tokens of the training documents; the chain
learns weights of words, word beginnings and transitions from windows of them, and
scores every token of every text by forward-backward marginals. A document's score
weighs its likeliest token and its expected number of toxic ones; its spans are the
runs above one half.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch
from tradeweave.llm.tasks import bounded

#: Labelled documents that a model is fitted on at most; also bounds what is broadcast.
TRAIN_DOCS = 40_000
#: Windows of tokens collected for fitting at most.
TRAIN_WINDOWS = 12_000
AROUND = 12
LEAST_DOCS = 5
BEGINNING = 5
_WORD = re.compile(r"\w+")
#: Marginals below this do not add up over a long document.
FAINT = 0.05
#: Words whose weights a task remembers at most.
KEPT = 300_000


def word_list(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


@dataclass
class Chain:
    """Weights for "toxic" of words and word beginnings, and of the transitions.

    ``step[i][j]`` is the weight of label j after label i.
    """

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, -3.0), (0.0, -1.0))
    bias: float = -6.0
    #: Weights of 1 and of the document's evidence in its score.
    document: tuple[float, ...] = (-4.0, 0.0, 4.0)
    _settled: tuple | None = field(default=None, repr=False, compare=False)

    def weight(self, word: str) -> float:
        """What a word adds to the bias."""
        word = word.lower()
        return self.words.get(word, 0.0) + self.beginnings.get(word[:BEGINNING], 0.0)

    def settled(self) -> tuple[float, float]:
        """The forward and backward log-odds far from any weighted token, found once per chain."""
        key = (self.step, self.bias)
        if self._settled is None or self._settled[0] != key:
            (a00, a01), (a10, a11) = [[math.exp(min(x, 50.0)) for x in row] for row in self.step]
            e = math.exp(min(self.bias, 50.0))
            b = a00 - a11 * e

            def fixed(into: float, out: float) -> float:
                """Log of the positive root r of r = (into + a11 e r) / (a00 + out e r)."""
                root = math.sqrt(b * b + 4 * into * out * e)
                return math.log(2 * into / (b + root) if b > 0 else (root - b) / (2 * out * e))

            self._settled = (key, (fixed(a01, a10), fixed(a10, a01)))
        return self._settled[1]

    def marginals(self, weights: list[tuple[int, float]], n: int) -> list[tuple[int, float]]:
        """(position, probability) of the tokens with weights and their neighbours.

        Forward and backward log-odds between weighted tokens settle at fixed
        values; where they have, positions are skipped. All positions not returned
        have the settled probability.
        """
        (a00, a01), (a10, a11) = [[math.exp(min(x, 50.0)) for x in row] for row in self.step]
        bias = self.bias

        def ahead(z: float) -> float:
            r = math.exp(min(z, 50.0))
            return math.log((a01 + a11 * r) / (a00 + a10 * r))

        def back(z: float) -> float:
            r = math.exp(min(z, 50.0))
            return math.log((a10 + a11 * r) / (a00 + a01 * r))

        def sweep(items, first: int, move, sign: int, fixed: float) -> dict[int, float]:
            """Message into each position that is near a weighted one, own weight excluded."""
            into: dict[int, float] = {}
            at, message, settled = first, 0.0, False
            for place, w in items:
                while at != place and not settled:
                    into[at] = message
                    new = move(bias + message)
                    settled = abs(new - fixed) < 1e-9
                    message, at = new, at + sign
                at = place
                into[at] = message
                message, at, settled = move(bias + w + message), at + sign, False
            while 0 <= at < n and not settled:
                into[at] = message
                new = move(bias + message)
                settled = abs(new - fixed) < 1e-9
                message, at = new, at + sign
            return into

        ahead_fixed, back_fixed = self.settled()
        fore = sweep(weights, 0, ahead, 1, ahead_fixed)
        rear = sweep(weights[::-1], n - 1, back, -1, back_fixed)
        own = dict(weights)
        out = []
        for at in sorted(fore.keys() | rear.keys()):
            z = bias + own.get(at, 0.0) + fore.get(at, ahead_fixed) + rear.get(at, back_fixed)
            out.append((at, 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))))
        return out

    @staticmethod
    def evidence(marginals: list[tuple[int, float]]) -> tuple[float, float]:
        """Log-odds of the likeliest token, and log of one plus the expected toxic tokens.

        Faint marginals are left out of the sum, or long texts would look toxic.
        """
        most = max((p for _, p in marginals), default=0.0)
        most = min(max(most, 1e-3), 1 - 1e-3)
        return math.log(most / (1 - most)), math.log1p(sum(p for _, p in marginals if p >= FAINT))

    def score(self, marginals: list[tuple[int, float]]) -> float:
        z = sum(w * x for w, x in zip(self.document, (1.0, *self.evidence(marginals)), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _forward_backward(e: np.ndarray, size: np.ndarray, step: np.ndarray):
    """Marginals of label 1 [windows, tokens], and expected counts of each step."""
    rows, n = e.shape
    a = np.exp(step)
    f = np.zeros((rows, n, 2))
    pot = np.stack([np.ones_like(e), np.exp(np.clip(e, -50, 50))], axis=2)
    f[:, 0] = pot[:, 0]
    f[:, 0] /= f[:, 0].sum(1, keepdims=True)
    for t in range(1, n):
        f[:, t] = (f[:, t - 1] @ a) * pot[:, t]
        f[:, t] /= f[:, t].sum(1, keepdims=True)
    b = np.ones((rows, n, 2))
    for t in range(n - 2, -1, -1):
        v = (b[:, t + 1] * pot[:, t + 1]) @ a.T
        v /= v.sum(1, keepdims=True)
        b[:, t] = np.where((t + 1 < size)[:, None], v, 1.0)
    g = f * b
    g /= g.sum(2, keepdims=True)
    pair = f[:, :-1, :, None] * a[None, None] * (b[:, 1:] * pot[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    live = np.arange(1, n)[None, :] < size[:, None]
    return g[:, :, 1], (pair * live[:, :, None, None]).sum((0, 1))


def fit_chain(windows: list[list[str]], labels: list[list[int]], rounds: int = 60) -> Chain:
    """Maximise the windows' conditional likelihood, with a penalty on large weights."""
    vocabulary: dict[str, int] = {}
    n = max(map(len, windows))
    word = np.zeros((len(windows), n), np.int64)
    beginning = np.zeros((len(windows), n), np.int64)
    y = np.zeros((len(windows), n))
    size = np.array([len(w) for w in windows])
    seen: dict[str, int] = {}
    for w in windows:
        for x in set(w) | {"^" + x[:BEGINNING] for x in w}:
            seen[x] = seen.get(x, 0) + 1
    marked = {x for w, own in zip(windows, labels, strict=True) for x, toxic in zip(w, own, strict=True) if toxic}
    for i, (w, own) in enumerate(zip(windows, labels, strict=True)):
        for t, x in enumerate(w):
            if seen[x] > 1 or x in marked:
                word[i, t] = vocabulary.setdefault(x, len(vocabulary) + 1)
            start = "^" + x[:BEGINNING]
            if seen[start] > 1:
                beginning[i, t] = vocabulary.setdefault(start, len(vocabulary) + 1)
        y[i, : len(own)] = own
    live = np.arange(n)[None, :] < size[:, None]
    k = len(vocabulary) + 1
    theta = np.zeros(k + 5)  # weights, then bias, then steps
    theta[k], theta[k + 1 :] = -4.0, (0.0, -2.0, 0.0, 0.0)
    both = live[:, 1:]
    told = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            told[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()
    total = np.zeros_like(theta)
    for _ in range(rounds):
        theta[0] = 0.0
        e = theta[word] + theta[beginning] + theta[k]
        p, steps = _forward_backward(e, size, theta[k + 1 :].reshape(2, 2))
        miss = np.where(live, y - p, 0.0)
        gradient = np.zeros_like(theta)
        gradient[:k] = np.bincount(word.ravel(), miss.ravel(), k) + np.bincount(beginning.ravel(), miss.ravel(), k)
        gradient[k] = miss.sum()
        gradient[k + 1 :] = (told - steps).ravel()
        gradient -= 0.02 * theta
        gradient[0] = 0.0
        total += gradient**2
        theta += 0.7 * gradient / np.sqrt(total + 1e-8)
    step = theta[k + 1 :]
    names = {i: x for x, i in vocabulary.items()}
    strong = [(names[i], float(theta[i])) for i in range(1, k) if abs(theta[i]) > 0.05]
    return Chain(
        {x: w for x, w in strong if x[0] != "^"},
        {x[1:]: w for x, w in strong if x[0] == "^"},
        ((float(step[0]), float(step[1])), (float(step[2]), float(step[3]))),
        float(theta[k]),
    )


def _windows(marked: set[str], seed: int):
    """One window per document: around a marked word in toxic ones; in others around a
    word that looks like one, if there is any, so that the chain learns to tell them."""
    starts = {x[:BEGINNING] for x in marked}

    def windows(batches):
        for batch in batches:
            out_w, out_y, out_r = [], [], []
            cols = [batch.column(i).to_pylist() for i in range(3)]
            for doc_id, text, toxic in zip(*cols, strict=True):
                tokens = [x.lower() for x in _WORD.findall(text)]
                if toxic:
                    at = [i for i, x in enumerate(tokens) if x in marked]
                else:
                    at = [i for i, x in enumerate(tokens) if x[:BEGINNING] in starts]
                if toxic and not at or not tokens:
                    continue
                # a repeatable place that does not depend on the partition
                spread = (hash((doc_id or 0, seed)) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
                centre = at[spread % len(at)] if at else spread % len(tokens)
                low = max(0, centre - AROUND)
                window = tokens[low : centre + AROUND + 1]
                out_w.append(window)
                out_y.append([int(bool(toxic) and x in marked) for x in window])
                out_r.append(spread >> 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out_w, pa.list_(pa.string())),
                    pa.array(out_y, pa.list_(pa.int32())),
                    pa.array(out_r, pa.int64()),
                ],
                names=["words", "labels", "place"],
            )

    return windows


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """Texts to learn from: the ``most`` labelled ones with the lowest hash of their id.

    Only ids are shuffled; the chosen ones, bounded in number, go to where the texts
    are read.
    """
    chosen = (
        labels.where(labels["toxic"].isNotNull() & ~F.coalesce(held_out(labels["doc_id"]), F.lit(True)))
        .select(labels["doc_id"].alias("_l"), labels["toxic"].cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.lit("fit"), "_l"), "_l", "toxic")
        .limit(most)
    )
    rows = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_l")).select("doc_id", "text", "toxic")


def train(known: DataFrame, most_windows: int = TRAIN_WINDOWS) -> Chain:
    """A chain from labelled texts (doc_id, text, toxic 0/1), none of them missing.

    One window of each of ``most_windows`` documents is fitted. Without any toxic
    word the chain gives every text a score near 0.
    """
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return Chain()
    words = known.select((F.col("toxic") == 1).cast("long").alias("t"), F.explode(word_list(F.col("text"))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    # of the documents with the word, most are toxic, also by a cautious estimate
    marks = (
        counts.where((F.col("t") >= LEAST_DOCS) & ((F.col("t") + 1) / (F.col("n") + 3) > 0.6))
        .orderBy(F.desc("t"), "w")
        .limit(5000)
    )
    strength = {r["w"]: r["t"] for r in marks.collect()}  # bounded by the limit: the commonest marks
    marked = _own_marks(known, strength) if strength else set()
    if not marked:
        return Chain()
    rows = known.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    found = rows.mapInArrow(bounded(_windows(marked, 1)), "words array<string>, labels array<int>, place long")
    sample = found.orderBy("place").limit(most_windows).collect()  # bounded by the limit
    chain = fit_chain([r["words"] for r in sample], [r["labels"] for r in sample])
    return _fit_documents(chain, rows)


def _fit_documents(chain: Chain, rows: DataFrame) -> Chain:
    """Weigh the evidence of whole documents, by logistic regression on the training ones.

    Tasks count documents by their rounded evidence, so that the driver gets a table
    of bounded size.
    """

    def evidence(batches):
        read = reader(chain)
        for batch in batches:
            found = [chain.evidence(read(t)[0]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([round(a, 1) for a, _ in found], pa.float64()),
                    pa.array([round(b, 1) for _, b in found], pa.float64()),
                    batch.column(2).cast(pa.int32()),
                ],
                names=["a", "b", "toxic"],
            )

    table = rows.mapInArrow(bounded(evidence), "a double, b double, toxic int").groupBy("a", "b", "toxic").agg(F.count(F.lit(1)).alias("n"))
    got = [(r["a"], r["b"], r["toxic"], r["n"]) for r in table.collect()]
    x = np.array([(1.0, a, b) for a, b, _, _ in got])
    y = np.array([float(t) for *_, t, _ in got])
    n = np.array([float(k) for *_, k in got])
    w = np.array([-4.0, 0.0, 4.0])
    prior = np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (n * (y - p)) - prior @ w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior + 1e-9 * np.eye(3), gradient)
        w = w + np.clip(step, -1.0, 1.0)
    chain.document = tuple(float(v) for v in w)
    return chain


def _own_marks(known: DataFrame, strength: dict[str, int]) -> set[str]:
    """Marks that are among the strongest of their document in most toxic documents.

    What merely stands in copies of a toxic text is weaker than what makes it toxic.
    """
    table = known.sparkSession.createDataFrame(list(strength.items()), "w string, s long")
    toxic = known.where("toxic = 1").select(
        F.monotonically_increasing_id().alias("row"), F.explode(word_list(F.col("text"))).alias("w")
    )
    met = toxic.join(F.broadcast(table), "w")  # at most 5000 words
    met = met.groupBy("row").agg(F.max("s").alias("top"), F.collect_list(F.struct("w", "s")).alias("all"))
    met = met.select("top", F.explode("all").alias("x")).select("top", F.col("x.w").alias("w"), F.col("x.s").alias("s"))
    share = met.groupBy("w").agg(F.avg((2 * F.col("s") >= F.col("top")).cast("double")).alias("own"))
    return {r["w"] for r in share.where("own >= 0.3").collect()}


SCHEMA = "doc_id long, score double, spans array<struct<start:int,end:int,probability:double>>"


def reader(chain: Chain):
    """text -> (marginals near words with weights, number of words)."""
    seen: dict[str, float] = {}
    none = chain.marginals([], 4)

    def read(text: str | None) -> tuple[list[tuple[int, float]], int]:
        if len(seen) > KEPT:
            seen.clear()
        words = _WORD.findall(text or "")
        weights = []
        get, weight = seen.get, chain.weight
        for i, x in enumerate(words):
            w = get(x)
            if w is None:
                w = seen[x] = weight(x)
            if w:
                weights.append((i, w))
        return (chain.marginals(weights, len(words)), len(words)) if weights else (none, 0)

    return read


def scorer(chain: Chain):
    """text -> (score, spans as (start, end, highest probability) in characters)."""
    read = reader(chain)

    def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        marginals, n = read(text)
        toxic = {i: p for i, p in marginals if p >= 0.5} if n else {}
        spans: list[tuple[int, int, float]] = []
        if toxic:
            last, before = max(toxic), -2
            for i, m in enumerate(_WORD.finditer(text)):
                if i > last:
                    break
                if i in toxic:
                    if before == i - 1:
                        spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], toxic[i]))
                    else:
                        spans.append((m.start(), m.end(), toxic[i]))
                    before = i
        return chain.score(marginals), spans

    return score


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, score and toxic spans (character offsets) of every row.

    Missing, empty and wordless texts get the score of a text without any known
    word. Rows are scored one by one: repeated ids and missing ids need no care.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        score = scorer(chain)
        for batch in batches:
            found = [score(t) for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "score", "spans"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(bounded(run), SCHEMA)


def reject_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        score = scorer(chain)
        for batch in batches:
            clean = [score(t)[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(bounded(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit on labelled documents that are not held out, at most TRAIN_DOCS of them."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = scratch.table(training_rows(docs, labels), "training")
    chain = train(known)
    scratch.drop()
    return chain


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, chain).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
