"""Packing token sequences: best-fit decreasing over bounded batches of documents.

A document longer than a window is first cut into full windows and a rest. The
pieces of a batch are placed from longest to shortest, each into the open window
with the least room that still holds it; a segment tree indexed by remaining
capacity finds that window in logarithmic time. Every task packs what it reads, so
no row is shuffled and memory is bounded by the batch; sequence ids carry the
partition, so that a task that runs again gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.tasks import bounded
from tradeweave.llm.tokens import IDS, encoder

WINDOW = 1024
END_ID = 0
#: Entries of a worker's table of encoded words.
WORDS_KEPT = 1_000_000
#: Tokens that a task holds before it packs them.
BATCH_TOKENS = 2_000_000

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Open windows by remaining capacity 0..size, with the smallest capacity at or
    above a wanted one found by walking a tree of counts."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.base + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def pop_tightest(self, wanted: int) -> tuple[int, int] | None:
        """The window with the least capacity >= wanted, and that capacity."""
        node = self.base + wanted
        if not self.count[node]:
            # up to the first right sibling with something open, then down its left edge
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.base
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece; no length may exceed the window.

    Ties keep their order; a zero length is placed like any other.
    """
    tree, windows = CapacityTree(window), 0
    place = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.pop_tightest(n)
        if found is None:
            found = (windows, window)
            windows += 1
        w, room = found
        place[i], offset[i] = w, window - room
        if room > n:
            tree.push(room - n, w)
    return place, offset


class _Packer:
    def __init__(self, window: int, partition: int):
        self.window, self.sequence = window, partition << 36
        self.docs: list[tuple[int | None, bytes]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> bool:
        self.docs.append((doc_id, ids))
        self.tokens += len(ids) // 4
        return self.tokens >= BATCH_TOKENS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        totals = np.array([len(ids) // 4 for _, ids in self.docs], np.int64)
        full, rest = np.divmod(totals, self.window)
        pieces = full + (rest > 0)
        doc = np.repeat(np.arange(len(totals)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * self.window
        length = np.minimum(self.window, totals[doc] - start)
        place, offset = best_fit_decreasing(length, self.window)
        ids = [
            self.docs[d][1][4 * s : 4 * (s + n)]
            for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)
        ]
        names = [self.docs[d][0] for d in doc.tolist()]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array(totals[doc]),
                pa.array(place + self.sequence),
                pa.array(offset),
                pa.array(ids, pa.binary()),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        self.sequence += int(place.max()) + 1 if len(place) else 0
        self.docs, self.tokens = [], 0
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, words_kept: int = WORDS_KEPT
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    One row per piece: doc_id, start (its document's ids before it), length,
    doc_tokens (with the end id), sequence_id, offset in the sequence, and the ids
    as little-endian unsigned 32-bit integers. A missing or empty text is the end
    id alone. Repeated rows and rows without doc_id are packed like any other, each
    on its own. The text of a sequence is its pieces in order of offset. ``words_kept``
    bounds the table of encoded words that a worker keeps; it changes nothing else.
    """
    end = np.array([end_id], IDS).tobytes()

    def pack_partition(batches):
        encode = encoder(tokenizer, words_kept).encode
        packer = _Packer(window, TaskContext.get().partitionId())
        for batch in batches:
            names = batch.column(0).to_pylist()
            for doc_id, ids in zip(names, encode(batch.column(1).to_pylist()), strict=True):
                if packer.add(doc_id, ids + end):
                    yield from packer.flush()
        yield from packer.flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(bounded(pack_partition), SCHEMA)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece with the checksum of its ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
