"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language by rank. A document's own
ranking is compared with every profile by the out-of-place distance: the sum of the
differences in rank, with a fixed penalty for n-grams that a profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.tasks import bounded

PROFILE = 400
DOC_GRAMS = 300
LONGEST = 3
UNKNOWN = "und"
#: Characters counted at a time; bounds memory on very long texts.
SLICE = 1 << 20
#: A training task adds up counts of this many distinct n-grams before it sends them on.
HELD = 200_000

_kinds: dict[int, int] = {}


def _letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, every run of other signs as one space."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(x):
        return x
    top = int(x.max())
    if top < 128:
        letter = (x >= 97) & (x <= 122)
    else:
        table = _table(0x300)
        letter = table[np.minimum(x, 0x2FF)]
        far = np.flatnonzero(x >= 0x300)
        if len(far):
            letter = letter.copy()
            letter[far] = [_is_letter(c) for c in x[far].tolist()]
    x = np.where(letter, x, 32).astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return x[keep]


def _is_letter(c: int) -> bool:
    if c not in _kinds:
        _kinds[c] = int(chr(c).isalpha())
    return bool(_kinds[c])


_tables: dict[int, np.ndarray] = {}


def _table(n: int) -> np.ndarray:
    if n not in _tables:
        _tables[n] = np.array([chr(c).isalpha() for c in range(n)])
    return _tables[n]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a text; spaces only bound words.

    A code holds 21 bits per character. Grams of spaces alone are left out.
    """
    parts = []
    text = (text or "").lower()
    behind = np.array([32], np.int64)  # the last two signs met: grams may lie across slices
    for at in range(0, len(text) + 1, SLICE):
        x = _letters(text[at : at + SLICE]).astype(np.int64)
        if at + SLICE > len(text):
            x = np.concatenate([x, [32]])
        if len(x) and x[0] == 32 and behind[-1] == 32:
            x = x[1:]
        if not len(x):
            continue
        k = len(behind)
        x = np.concatenate([behind, x])
        if len(x) > 1 and x[-1] == x[-2] == 32:
            x = x[:-1]
        one = x[k:][x[k:] != 32]
        two = ((x[k - 1 : -1] << 21) | x[k:])[(x[k - 1 : -1] != 32) | (x[k:] != 32)]
        i = max(k, 2)
        three = ((x[i - 2 : -2] << 42) | (x[i - 1 : -1] << 21) | x[i:])[x[i - 1 : -1] != 32]
        codes, counts = np.unique(np.concatenate([one, two, three]), return_counts=True)
        if len(codes):
            parts.append((codes, counts))
        behind = x[-2:]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    return _added(parts)


def _added(parts) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    codes, where = np.unique(codes, return_inverse=True)
    return codes, np.bincount(where, counts, len(codes)).astype(np.int64)


def ranking(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(codes) > 4 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


def _count_languages(batches) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def send():
        for lang, parts in held.items():
            codes, counts = _added(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"]
            )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, counts = gram_counts(text)
            if len(codes):
                held.setdefault(lang, []).append((codes, counts))
                size += len(codes)
            if size > 10 * HELD:
                held = {k: [_added(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD:
                    yield from send()
                    held, size = {}, 0
    yield from send()


def profiles(labelled: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of every language in ``labelled(lang, text)``, from all its rows.

    Tasks add up counts before the shuffle. The driver receives ``most`` n-grams per
    language.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(bounded(_count_languages), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    out: dict[str, list] = {}
    for r in top.select("lang", "gram", "rank").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(v)], np.int64) for lang, v in sorted(out.items())}


class Identifier:
    """Compares rankings with profiles."""

    def __init__(self, known: dict[str, np.ndarray], grams: int = DOC_GRAMS, penalty: int = PROFILE):
        self.langs, self.grams, self.penalty = sorted(known), grams, penalty
        self.tables = []
        for lang in self.langs:
            order = np.argsort(known[lang])
            self.tables.append((known[lang][order], order))

    def distances(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        own = ranking(codes, counts, self.grams)
        place = np.arange(len(own))
        out = np.zeros(len(self.langs))
        for i, (grams, ranks) in enumerate(self.tables):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            found = grams[at] == own
            out[i] = np.where(found, np.minimum(np.abs(ranks[at] - place), self.penalty), self.penalty).sum() / len(own)
        return out

    def identify(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much nearer it is than the next, 0.5 to 1.

        Without any letter, or without any profile, the language is unknown and the
        score 0. Ties go to the first language in code-point order.
        """
        codes, counts = gram_counts(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        d = self.distances(codes, counts)
        best = int(d.argmin())
        if len(d) == 1:
            return self.langs[best], float(1 - d[best] / self.penalty)
        second = float(np.partition(d, 1)[1])
        total = second + float(d[best])
        return self.langs[best], second / total if total else 0.5


def identify_languages(docs: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row; null and letterless texts are unknown."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(known)
        for batch in batches:
            found = [identifier.identify(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(bounded(run), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Every document with the language told by its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = profiles(docs.where(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"])))
    return identify_languages(docs, known).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
