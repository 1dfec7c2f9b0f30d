"""Token ids in files of 64-bit words: Simple-8b with escapes and block offsets.

The four highest bits of a word select how many ids share the other sixty. A block
holds 1024 ids (the last of a file fewer) and starts at a word of its own, recorded
in the file, so that blocks decode apart from each other and, with numpy, all at
once. An id that does not fit sixty bits follows its escape word as it is.

Layout, little-endian: magic, number of documents, ids and blocks and words, then
doc ids, ids per document, first word of each block, words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch, commit_file
from tradeweave.llm.tokens import IDS, encoder

MAGIC = b"S8BIDS01"
BLOCK = 1024
END_ID = 1
#: Ids after which a task starts another file.
FILE_IDS = 2_000_000
#: Blocks that are encoded at a time; bounds memory and fits a processor's cache.
TOGETHER = 512
#: Fixed values of the coding: selector -> (ids in a word, bits of each).
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
#: A word of selector 1 (a run of 120 zeros) with a payload marks an escaped id.
ESCAPE = np.uint64((1 << 60) | 1)


_BITS = np.array([b.bit_length() for b in range(1 << 16)], np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    bits = _BITS[x & np.uint64(0xFFFF)]
    for shift in (16, 32, 48) if x.size and int(x.max()) >> 16 else ():
        part = _BITS[(x >> np.uint64(shift)) & np.uint64(0xFFFF)]
        bits = np.where(part > 0, part + np.uint8(shift), bits)
    return bits


_TAKE = np.array([count for count, _ in SELECTORS] + [1], np.int64)


def _over(need: np.ndarray, by: int) -> np.ndarray:
    """The higher need of each run and of the one that starts ``by`` later in the block."""
    out = np.full(need.shape, 61, np.uint8)
    np.maximum(need[:, :-by], need[:, by:], out=out[:, :-by])
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the first word of each block."""
    words, first, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for start in range(0, len(ids), TOGETHER * BLOCK):
        own, begins = _encode_blocks(ids[start : start + TOGETHER * BLOCK])
        words.append(own)
        first.append(begins + at)
        at += len(own)
    return np.concatenate(words), np.concatenate(first)


def _encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In every block each word takes the longest run of ids that fits a selector; the
    blocks advance together, a word per step."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.zeros(blocks * BLOCK, np.uint64)
    x[:n] = ids
    x = x.reshape(blocks, BLOCK)
    size = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    need = _bits(x)
    need[np.arange(BLOCK)[None, :] >= size[:, None]] = 61  # ends a run
    # what fits a longer run of fewer bits also fits all shorter ones: count what fits
    fitting = np.zeros(x.shape, np.uint8)
    known = {1: need}  # highest need over runs of a length
    power = 1
    while power < 128:
        known[2 * power] = _over(known[power], power)
        power *= 2
    for count, bits in SELECTORS:
        if count not in known:
            half = 1 << (count.bit_length() - 1)
            known[count] = _over(known[half], count - half)
        fitting += known[count] <= bits
    best = np.uint8(16) - fitting  # 16: escape
    take = _TAKE[best]
    at = np.zeros(blocks, np.int64)
    begins = np.zeros(x.shape, bool)
    live = np.arange(blocks)
    while len(live):
        a = at[live]
        begins[live, a] = True
        a = a + take[live, a]
        at[live] = a
        live = live[a < size[live]]
    base = np.flatnonzero(begins)
    row, selector, flat = base // BLOCK, best.reshape(-1)[base], x.reshape(-1)
    width = 1 + (selector == 16)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        these = np.flatnonzero(selector == s)
        if s == 16:
            words[place[these]] = ESCAPE
            words[place[these] + 1] = flat[base[these]]
            continue
        count, bits = SELECTORS[s]
        word = np.full(len(these), s << 60, np.uint64)
        for k in range(count if bits else 0):
            word |= flat[base[these] + k] << np.uint64(k * bits)
        words[place[these]] = word
    first = np.searchsorted(row, np.arange(blocks))
    return words, place[first]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ids of consecutive whole blocks of words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    escape = words == ESCAPE
    if escape.any():
        # a word after an escape is a value, also if it looks like an escape
        marks = np.flatnonzero(escape)
        keep = []
        last = -2
        for m in marks.tolist():
            if m != last + 1:
                keep.append(m)
                last = m
        escape = np.zeros(len(words), bool)
        escape[keep] = True
    value = np.zeros(len(words), bool)
    value[1:] = escape[:-1]
    counts = np.array([c for c, _ in SELECTORS], np.int64)[selector]
    counts[escape] = 0
    counts[value] = 1
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    out[place[value]] = words[value]
    plain = ~(escape | value)
    for s in range(2, 16):
        these = np.flatnonzero(plain & (selector == s))
        count, bits = SELECTORS[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if len(these) else 0):
            out[place[these] + k] = (words[these] >> np.uint64(k * bits)) & mask
    return out[:n]


def to_file(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    """A file's content."""
    words, first = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(first), len(words)], "<i8")
    parts = (head, np.array(doc_ids, "<i8"), np.array(counts, "<i8"), first.astype("<i8"), words.astype("<u8"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def from_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, ids per document, and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, n, blocks, words = np.frombuffer(content, "<i8", 4, 8).tolist()
    at = 40
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    counts = np.frombuffer(content, "<i8", docs, at + 8 * docs)
    at += 16 * docs + 8 * blocks
    return doc_ids, counts, decode(np.frombuffer(content, "<u8", words, at), n)


def read_block(content: bytes, block: int) -> np.ndarray:
    """The ids of one block, without touching the others."""
    docs, n, blocks, words = np.frombuffer(content, "<i8", 4, 8).tolist()
    at = 40 + 16 * docs
    first = np.append(np.frombuffer(content, "<i8", blocks, at), words)
    own = np.frombuffer(content, "<u8", first[block + 1] - first[block], at + 8 * blocks + 8 * int(first[block]))
    return decode(own, min(BLOCK, n - block * BLOCK))


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    """Encode all texts and write the files, in ascending doc_id order.

    Files are numbered by partition and place in it, so that their names sort like
    their doc ids. Each is written under a temporary name and then renamed; an
    attempt that is repeated writes the same content. Missing texts are empty; every
    document ends with the end id. Rows without doc_id come first, as id -2^63;
    repeated ids are ordered by text.
    """
    end = np.array([end_id], IDS).tobytes()
    smallest = -(1 << 63)

    def write(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(folder)
        encode_texts = encoder(tokenizer).encode
        partition, files = TaskContext.get().partitionId(), 0
        names: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush():
            nonlocal files, names, held, total
            raw = b"".join(held)
            content = to_file(names, [len(h) // 4 for h in held], np.frombuffer(raw, IDS).astype(np.uint64))
            final = f"{root}/part-{partition:06d}-{files:06d}.s8b"
            temporary = f"{root}/_tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(content)
            commit_file(store, temporary, final)
            files += 1
            row = pa.RecordBatch.from_pydict({"file": [final], "ids": [total], "bytes": [len(content)]})
            names, held, total = [], [], 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encode_texts(part.column(1).to_pylist())
                for doc_id, own in zip(part.column(0).to_pylist(), ids, strict=True):
                    names.append(smallest if doc_id is None else doc_id)
                    held.append(own + end)
                    total += len(own) // 4 + 1
                    if total >= FILE_IDS:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(write, "file string, ids long, bytes long")
    written.write.mode("overwrite").parquet(f"{folder}/_manifest")


def read_ids(spark, folder: str) -> DataFrame:
    """Documents of a folder of files: file, doc_id, place in the file, ids (binary)."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, counts, ids = from_file(content)
                starts = np.cumsum(counts) - counts
                raw = ids.astype(IDS).tobytes()
                for at in range(0, len(doc_ids), 2000):
                    own = [
                        raw[4 * s : 4 * (s + n)]
                        for s, n in zip(starts[at : at + 2000].tolist(), counts[at : at + 2000].tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * len(own)),
                            pa.array(doc_ids[at : at + 2000], pa.int64()),
                            pa.array(starts[at : at + 2000], pa.int64()),
                            pa.array(own, pa.binary()),
                        ],
                        names=["file", "doc_id", "start_in_file", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")
    rows = files.mapInArrow(read, "file string, doc_id long, start_in_file long, ids binary")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document as read back from the files, with the checksum of its ids."""
    import public_tokenizers

    folder = Scratch(spark, "ids").folder("files")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    files = spark.read.parquet(f"{folder}/_manifest")
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    name = F.element_at(F.split("file", "/"), -1)
    base = files.select(name.alias("_name"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_base"))
    docs = read_ids(spark, folder).withColumn("_file", name)
    return docs.join(base, F.col("_file") == F.col("_name")).select(
        "doc_id",
        (F.col("_base") + F.col("start_in_file")).alias("start"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
