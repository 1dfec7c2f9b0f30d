"""Deterministic WARC shards: written, committed by renaming, and read back.

Records are range-sorted by page id and digest: small keys first, whose running sum of
bytes is cut into shards, then the pages, each sent to its shard. The cuts follow from
the data alone, so that the same pages give the same files whatever the cluster, and
every shard is one task of bounded size; a shard rolls to a further file when its
compressed size reaches a limit.
Headers and digests are made anew from the payload. Files are written under a
temporary name and renamed; the manifest, a table, lists those that count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.llm.scratch import Scratch, commit_file

SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
LEAST_REVISIT = 100
#: Stands for a missing id, before all others.
LEAST_ID = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, again: str = ""
) -> bytes:
    """The response, or the revisit of another page with the same payload.

    Control characters and spaces in a URL are percent-encoded; a missing URL is
    about:blank, a missing id an empty one. ``again`` tells records of one id apart.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    headers = [
        ("WARC-Record-ID", f"<urn:page:{again}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", target),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return record("response", headers, block)
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return record("revisit", headers, block)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
        while first := stream.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            block = stream.read(int(headers["content-length"]))
            stream.readline()
            stream.readline()
            yield headers, block


def _writer(folder: str, file_bytes: int):
    def write(batches) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        shard, part, held, size, count = None, 0, [], 0, 0

        def flush():
            nonlocal part, held, size, count
            name = f"shard-{shard:06d}-{part:04d}.warc.gz"
            content = b"".join(held)
            temporary = f"{root}/_tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(content)
            commit_file(store, temporary, f"{root}/{name}")
            part += 1
            row = {"file": [name], "records": [count], "bytes": [len(content)], "sha256": [hashlib.sha256(content).hexdigest()]}
            held, size, count = [], 0, 0
            return pa.RecordBatch.from_pydict(row)

        page, firsts, nth = None, {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols = [c.to_pylist() for c in batch.slice(at, 256).columns]
                for own, page_id, kind, digest, first, url, payload in zip(*cols, strict=True):
                    if own != shard:
                        if count:
                            yield flush()
                        shard, part, page, firsts, nth = own, 0, None, {}, 0
                    if page_id != page:
                        page, firsts, nth = page_id, {}, 0
                    if not kind:  # what a page's payload refers to comes before the page
                        firsts[digest] = first
                        continue
                    if not count:
                        info = record("warcinfo", [("WARC-Record-ID", f"<urn:file:{own}:{part}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        held.append(info)
                        size += len(info)
                    # a page that repeats an id, or has none, gets a number before it
                    again = f"{own}-{nth}:" if nth or page_id is None else ""
                    nth += 1
                    made = page_record(page_id, url, payload, firsts.get(digest), again=again)
                    held.append(made)
                    size += len(made)
                    count += 1
                    if size >= file_bytes:
                        yield flush()
        if count:
            yield flush()

    return write


def _digest_number(digest: str):
    """The first 48 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _running(batches) -> Iterator[pa.RecordBatch]:
    """Bytes before each row of the task's sorted keys."""
    before = 0
    for batch in batches:
        size = batch.column(2).to_numpy(zero_copy_only=False)
        ends = before + np.cumsum(size)
        part = np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(part), pa.array(ends - size)],
            names=["page_id", "place", "bytes", "part", "before"],
        )
        before = int(ends[-1]) if len(ends) else before


def _bounds(rows: DataFrame, shard_bytes: int, scratch: Scratch) -> list[tuple[int, int]]:
    """The first (page_id, digest number) of every shard, in order.

    Keys are sorted over the cluster with the running sum of their task; the tasks'
    sums give what comes before each. The driver gets two numbers per shard of
    ``shard_bytes``.
    """
    keys = rows.select("page_id", _digest_number("digest").alias("place"), (F.col("size") + 400).cast("long").alias("bytes"))
    keys = keys.repartitionByRange("page_id", "place").sortWithinPartitions("page_id", "place")
    keys = scratch.table(
        keys.mapInArrow(_running, "page_id long, place long, bytes long, part int, before long"), "keys"
    )
    parts = keys.groupBy("part").agg(F.sum("bytes").alias("_bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_base"))
    shard = F.floor((F.col("_base") + F.col("before")) / F.lit(shard_bytes))
    first = keys.join(parts, F.col("part") == F.col("_part")).groupBy(shard.alias("shard")).agg(
        F.min(F.struct(F.coalesce("page_id", F.lit(LEAST_ID)).alias("i"), F.col("place").alias("d"))).alias("f")
    )
    found = sorted({(r["f"]["i"], r["f"]["d"]) for r in first.collect()})
    scratch.drop(keys)
    return [(LEAST_ID, -1), *found[1:]]


def _place(bounds: list[tuple[int, int]]):
    """Shard of pages, from their ids and digest numbers."""
    import pandas as pd

    ids, places = (np.array(x, np.int64) for x in zip(*bounds, strict=True))

    def place(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        i = page_id.astype("Int64").fillna(LEAST_ID).to_numpy(np.int64)
        low, high = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
        shard = high - 1
        for k in np.flatnonzero(low < high).tolist():  # a shard begins within the rows of this id
            shard[k] = low[k] - 1 + np.searchsorted(places[low[k] : high[k]], digest.iat[k], "right")
        return pd.Series(np.maximum(shard, 0).astype(np.int32))

    # plain names: the annotations above are texts, and the function is sent without this module's
    place.__annotations__ = {"page_id": pd.Series, "digest": pd.Series, "return": pd.Series}
    return place


def write_archives(
    pages: DataFrame,
    folder: str,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Write all pages (page_id, url, html) and return the manifest.

    Of pages with equal payloads of at least 100 bytes the one with the smallest
    page_id is a response, the others revisit it; missing html is an empty payload,
    and all smaller ones are responses. Pages without id are written too, first of
    all; they revisit a page that has an id. Rows that repeat an id are written each,
    under a record id with a number. Shards hold about ``shard_bytes``; only rows alike
    in id and payload are never parted.
    """
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"], F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    bounds = _bounds(rows, shard_bytes, scratch or Scratch(pages.sparkSession, "shards"))
    large = rows.where(F.col("size") >= LEAST_REVISIT).select("digest", "page_id")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    revisits = large.join(groups.select(F.col("digest").alias("_d"), "first"), F.col("digest") == F.col("_d")).where(
        ~F.col("page_id").eqNullSafe(F.col("first"))
    )
    none = F.lit(None)
    both = rows.select("page_id", F.lit(True).alias("kind"), "digest", none.cast("long").alias("first"), "url", "payload").unionByName(
        revisits.select("page_id", F.lit(False).alias("kind"), "digest", "first", none.cast("string").alias("url"), none.cast("binary").alias("payload"))
    )
    shard = F.pandas_udf(_place(bounds), "int")("page_id", _digest_number("digest"))
    ordered = (
        both.select(shard.alias("shard"), "page_id", "kind", "digest", "first", "url", "payload")
        .repartitionById(len(bounds), "shard")
        .sortWithinPartitions("shard", "page_id", "kind", "digest", "url")
    )
    written = ordered.mapInArrow(_writer(folder, file_bytes), "file string, records long, bytes long, sha256 string")
    written.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.parquet(f"{folder}/_manifest")


def _read(batches) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def number(urn: str | None):
        digits = (urn or "").strip("<>").rpartition(":")[2]
        return int(digits) if digits else None

    for batch in batches:
        for path, content, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if hashlib.sha256(content).hexdigest() != sha:
                raise ValueError(f"{path} is not what the manifest lists")
            rows = []
            for headers, block in records(content):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                if "sha256:" + hashlib.sha256(block).hexdigest() != headers["warc-block-digest"]:
                    raise ValueError(f"{path}: a block differs from its digest")
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)\ncontent-length: (\d+)", head)[1])
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: a payload differs from its header")
                rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], kind, size, digest, number(headers.get("warc-refers-to")), payload if kind == "response" else None))
                if len(rows) == 500:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def read_archives(spark, folder: str) -> DataFrame:
    """The page records of the files that the manifest lists, digests checked."""
    listed = spark.read.parquet(f"{folder}/_manifest").select(F.col("file").alias("_file"), "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = files.join(listed, F.col("file") == F.col("_file"))
    return found.select("file", "content", "sha256").mapInArrow(
        _read,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
    )


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    folder = Scratch(spark, "warc").folder("archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> f THEN f END AS refers_to
FROM g
"""
