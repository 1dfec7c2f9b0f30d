"""Periodic runs of words: maximal stretches that repeat with some period.

Periods are sorted into octaves [P, 2P). For each octave a document falls into tiles
around boundaries P/2 words apart; a tile holds the words from P/2 before its boundary
to 4P behind it, so tiles overlap. A tile is solved on its own: the Z-function of the
words from the boundary on tells, for every period of the octave, how far words one
period apart agree to the right, and a comparison to the left how far they agree
before it. Every run of the octave agrees over at least P places and so covers a
boundary. What a tile finds is a fragment: a document, a period, and an interval of
agreeing places. Fragments are shuffled by document and period, where those that
overlap are stitched into one run.

Tiles are made and solved where the text is read, so no tile and no text without
fragments is shuffled; a tile takes time in proportion to its words whatever repeats
in it. Periods below 16 are one scale, with the document as its only tile.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch
from tradeweave.llm.tasks import bounded

#: A run has this many words and two periods at least.
LEAST = 12
#: Periods below this are the lowest scale; a power of two.
LOW = 16
#: Longer periods need this many words in a row to agree; at most half of LOW.
GRAM = 8
#: Comparisons of boundaries with the words behind them that are held at once.
HELD = 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

Fragment = tuple[int, int, int]  # period, first agreeing place, behind the last one


def _numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of all documents in a row, and where each starts and ends.

    Behind each document stand LOW negative numbers that occur nowhere else: no
    stretch of agreeing places leaves its document.
    """
    table: dict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    size = np.array([len(d) for d in docs], np.int64)
    start = np.cumsum(size + LOW) - size - LOW
    w = -1 - np.arange(int((size + LOW).sum()), dtype=np.int64)
    for s, words in zip(start.tolist(), docs, strict=True):
        w[s : s + len(words)] = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    return w, start, start + size


def _low_fragments(w: np.ndarray) -> Iterator[Fragment]:
    """Whole runs of the periods below LOW, those that are powers of a shorter one left out."""
    agree: dict[int, np.ndarray] = {}

    def agreeing(p: int) -> np.ndarray:
        """How many places before each agree with the word p behind them."""
        if p not in agree:
            agree[p] = np.concatenate([[0], np.cumsum(w[:-p] == w[p:])])
        return agree[p]

    for q in range(1, min(LOW, len(w))):
        same = np.zeros(len(w) - q + 2, np.int8)
        same[1:-1] = w[:-q] == w[q:]
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, end = edges[::2], edges[1::2]
        long = end - start >= max(q, LEAST - q)
        start, end = start[long], end[long]
        for p in range(1, q // 2 + 1):
            if q % p == 0 and len(start):
                count = agreeing(p)
                own = count[start + q - p] - count[start] < q - p
                start, end = start[own], end[own]
        yield from zip([q] * len(start), start.tolist(), end.tolist(), strict=True)


def _grams(w: np.ndarray) -> np.ndarray:
    """Equal where the next GRAM words are; only used to rule places out."""
    m = max(0, len(w) - GRAM + 1)
    h = np.zeros(len(w), np.uint64)
    for i in range(GRAM):
        h[:m] = (h[:m] ^ w[i : i + m].view(np.uint64)) * _MULTIPLY
        h[:m] ^= h[:m] >> np.uint64(29)
    return h


def _agree(w: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from a on are those from b on, at most ``most``; a < b."""
    done, step = 0, 32
    most = min(most, len(w) - b)
    while done < most:
        n = min(step, most - done)
        differ = w[a + done : a + done + n] != w[b + done : b + done + n]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += n
        step *= 4
    return max(done, 0)


def _agree_back(w: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words before a are those before b, at most ``most``; a < b."""
    done, step = 0, 32
    most = min(most, a)
    while done < most:
        n = min(step, most - done)
        differ = (w[a - done - n : a - done] != w[b - done - n : b - done])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += n
        step *= 4
    return done


def z_function(w: np.ndarray, c: int, places: list[int], most: int) -> dict[int, int] | None:
    """How far the words from c + i on agree with those from c on, for each i of ``places``.

    Values stop at ``most``. ``places`` ascend and hold every i at which GRAM or more
    words agree. As in the usual algorithm the farthest stretch found so far answers
    for places inside it, so every word is compared about once. None as soon as a
    quarter of ``most`` or less turns out to be a period of all the words looked at.
    """
    z: dict[int, int] = {}
    left = right = 0
    for i in places:
        known = 0
        if i < right:
            # a place without a value agrees for less than GRAM words
            known = z.get(i - left, 0)
            if 0 < known < right - i:
                z[i] = known
                continue
            known = min(known, right - i)
        z[i] = known + _agree(w, c + known, c + i + known, most - known)
        if z[i] >= most and 4 * i <= most:
            return None
        if i + z[i] > right:
            left, right = i, i + z[i]
    return z


def _tile(w: np.ndarray, c: int, places: list[int], octave: int) -> Iterator[Fragment]:
    """Fragments around the boundary c with periods in [octave, 2 * octave).

    A period whose words are a power of a shorter period's is left out; of one stretch
    all tiles decide that alike, since its periods are rotations of each other. Where
    half an octave or less is a period of all words behind the boundary, longer periods
    are its multiples, or agree for less than it: a run of theirs that has no earlier
    boundary would be shorter than the octave.
    """
    most, before = 2 * octave, octave // 2
    z = z_function(w, c, places, most)
    if z is None:
        return
    shortest = 0  # the first place with which the words up to q have a period
    for q in places:
        while places[shortest] + z[places[shortest]] < q and places[shortest] < q:
            shortest += 1
        p = places[shortest]
        if q < octave or not z[q] or (p < q and q % p == 0):
            continue
        back = _agree_back(w, c, c + q, before)
        if back < before and z[q] < most and back + z[q] < q:
            continue  # complete, and too short for a run
        yield q, c - back, c + z[q]


def _octave_fragments(w: np.ndarray, grams: np.ndarray, start, end, octave: int) -> Iterator[Fragment]:
    """Fragments of all documents with periods in [octave, 2 * octave)."""
    step = octave // 2
    padded = np.concatenate([grams, np.zeros(2 * octave, np.uint64)])
    behind = np.lib.stride_tricks.sliding_window_view(padded, 2 * octave)
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        if e - s < 2 * octave:
            continue
        # a boundary needs a word one period behind it
        centres = np.arange(s - s % step + (step if s % step else 0), e - octave, step)
        rows = max(1, HELD // octave)
        for at in range(0, len(centres), rows):
            part = centres[at : at + rows]
            met = behind[part, octave:] == grams[part][:, None]
            for k in np.flatnonzero(met.any(axis=1)).tolist():
                c = int(part[k])
                places = np.flatnonzero(behind[c, 1 : e - c] == grams[c]) + 1
                if len(places) and places[-1] >= octave:
                    yield from _tile(w, c, places.tolist(), octave)


def fragments(docs: list[list[bytes]]) -> list[list[Fragment]]:
    """What the tiles of each document find; see the module."""
    w, start, end = _numbered(docs)
    found = list(_low_fragments(w))
    longest = int((end - start).max()) if len(start) else 0
    octave, grams = LOW, _grams(w) if longest >= 2 * LOW else None
    while 2 * octave <= longest:
        found.extend(_octave_fragments(w, grams, start, end, octave))
        octave *= 2
    out: list[list[Fragment]] = [[] for _ in docs]
    owner = np.searchsorted(start, [s for _, s, _ in found], "right") - 1
    for k, (q, s, e) in zip(owner.tolist(), found, strict=True):
        out[k].append((q, s - int(start[k]), e - int(start[k])))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of every run (start, length, period) the first period only."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


_FRAGMENT = pa.struct([("period", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])


def _find(prepare: Callable | None, finish: Callable):
    """Documents without fragments are finished at once, the others keep their words."""

    def find(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            docs = [(t or b"").split() for t in texts]
            if prepare:
                docs = [prepare(name, words) for name, words in zip(names, docs, strict=True)]
            found = fragments(docs)
            keys = [xxhash.xxh3_128_digest(repr(n).encode() + b"\n" + (t or b"")) if f else None for n, t, f in zip(names, texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([None if f else finish(collapse(d, [])) for d, f in zip(docs, found, strict=True)], pa.string()),
                    pa.array([b" ".join(d) if f else None for d, f in zip(docs, found, strict=True)], pa.binary()),
                    pa.array([[dict(zip(("period", "first", "end"), x, strict=True)) for x in f] for f in found], pa.list_(_FRAGMENT)),
                ],
                names=["doc_id", "n_words", "key", "collapsed", "words", "fragments"],
            )

    return find


def _finish(finish: Callable):
    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out.append(finish(collapse(text.split(), [(r["start"], r["length"], r["period"]) for r in runs])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def stitch(found: DataFrame) -> DataFrame:
    """Runs (key, start, length, period) from fragments (key, period, first, end).

    Fragments of one document and period that touch or overlap are one stretch. No
    group is larger than a document.
    """
    order = Window.partitionBy("key", "period").orderBy("first", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = found.withColumn("_new", F.coalesce(F.col("first") > so_far, F.lit(True)).cast("int"))
    pieces = pieces.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("key", "period", "_run").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    agreeing = F.col("end") - F.col("start")
    return whole.where(agreeing >= F.greatest(F.col("period"), LEAST - F.col("period"))).select(
        "key", "start", (agreeing + F.col("period")).alias("length"), "period"
    )


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(
    docs: DataFrame,
    prepare: Callable | None = None,
    digest: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every row of (doc_id, text).

    A word is a run of anything but ASCII white space; words count from 0. A run is a
    stretch of words with smallest period q, at least max(12, 2 * q) words long, that
    no neighbouring word extends; ``runs`` holds (start, length, period) by start,
    then period. ``collapsed`` is the words, joined by one space, without those that
    some run holds after its first period; with ``digest`` its SHA-256 in hex, so that
    long texts need not be written. ``prepare(doc_id, words)`` may change the words
    first. Missing, empty and white texts have no words, no runs and an empty
    collapsed text. Rows are treated one by one: repeated rows each give a row with
    the same result, rows without doc_id are like any other.
    """
    scratch = scratch or Scratch(docs.sparkSession, "runs")
    finish = (lambda b: hashlib.sha256(b).hexdigest()) if digest else (lambda b: b.decode("utf-8", "replace"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    kind = "struct<period:long,first:long,end:long>"
    found = rows.mapInArrow(
        bounded(_find(prepare, finish)),
        f"doc_id long, n_words long, key binary, collapsed string, words binary, fragments array<{kind}>",
    )
    found = scratch.table(found, "found")
    none = F.array().cast(RUNS).alias("runs")
    plain = found.where(F.col("key").isNull()).select("doc_id", "n_words", none, "collapsed")
    met = found.where(F.col("key").isNotNull())
    pieces = met.select("key", F.explode("fragments").alias("f")).select("key", "f.*").distinct()
    runs = (
        stitch(pieces)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
        .select(
            F.col("key").alias("_key"),
            F.transform("_runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"),
        )
    )
    met = met.select("doc_id", "n_words", "key", "words").join(runs, F.col("key") == F.col("_key"), "left")
    met = met.select("doc_id", "n_words", "words", F.coalesce("runs", none).alias("runs"))
    done = met.mapInArrow(bounded(_finish(finish)), f"doc_id long, n_words long, runs {RUNS}, collapsed string")
    return plain.unionByName(done)


def repeat_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The planting rule of the query: of one document in ten, told by the checksum of
    its id, all words from a place on repeat with one period. Others, and those without
    id or words, stay."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (1 + (n - a) // p))[: n - a]


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of runs, its longest one, and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, repeat_words, digest=True)
    # the longest; of those the first; of those the shortest period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    found = found.withColumn("_top", top)
    length, start, period = F.col("_top.length"), -F.col("_top.col2"), -F.col("_top.col3")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor((1000 * length).cast("decimal(20,0)") / period.cast("decimal(20,0)")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
