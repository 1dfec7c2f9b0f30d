"""Near-dedup by min-max hashing.

A document is the set of its word shingles. Under each of 64 permutations of the
hash space both the smallest and the largest element are kept: 128 unbiased
signature values for 64 evaluations. 25 bands of five values propose pairs; the
proposals are confirmed on the full sets, and linked documents form components.

No bucket is expanded into all its pairs. The member that shares buckets most is
compared with all others; that joins what belongs together in most groups. Where a
bucket still spans several components, what remains is decided exactly: a document
can only link if enough of its shingles occur in any other document left over, so
most are ruled out by counting shingles, and only the rest is compared, with
members of other components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.graph import components, join_hot
from tradeweave.llm.scratch import Scratch
from tradeweave.llm.tasks import bounded

PERMUTATIONS = 64
BAND_ROWS = 5
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: A shingle set counts as so many small rows when files are sized.
SET_FILES = 32
#: Members of a group that a task compares with as many others.
BLOCK = 256
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * _M1)
_XOR, _MULTIPLY = _SEEDS[:PERMUTATIONS, None], _SEEDS[PERMUTATIONS:, None] | np.uint64(1)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    ASCII letters are lowered; words are runs of anything but ASCII white space.
    A text with fewer words is one shingle, one without words has none.
    """
    w = (text or b"").lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    k = min(words, n)
    m = n - k + 1
    s = np.full(m, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i : i + m]) * _M1
        s ^= s >> np.uint64(29)
    return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest, then the largest value under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        v = (shingles[None, at : at + 2048] ^ _XOR) * _MULTIPLY
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = sig[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = _mix((key ^ rows[:, i]) * _M1)
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes | None:
    """Equal sets have equal keys; an empty set has none."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _sketch(words: int):
    def sketch(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            keys = [set_key(s) for s in sets]
            bands = [band_keys(signature(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(
                        np.cumsum([0] + [len(b) for b in bands]).astype(np.int32), np.concatenate(bands)
                    ),
                ],
                names=["doc_id", "n", "node", "bands"],
            )

    return sketch


def _sets(words: int):
    """Shingle sets of texts whose set is the wanted one."""

    def sets(batches):
        for batch in batches:
            found = [
                (node, s)
                for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if set_key(s := shingle_set(t, words)) == node
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n, _ in found], pa.binary()),
                    pa.ListArray.from_arrays(
                        np.cumsum([0] + [len(s) for _, s in found]).astype(np.int32),
                        np.concatenate([s.view(np.int64) for _, s in found] or [np.zeros(0, np.int64)]),
                    ),
                ],
                names=["node", "shingles"],
            )

    return sets


def _lists(column) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b].view(np.uint64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _confirm(percent: int):
    def confirm(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keep)], names=["a", "b", "linked"]
            )

    return confirm


def _linkable(a: Column, b: Column, percent: int) -> Column:
    """Sizes alone do not rule a link out."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their
    shingle sets; components join what links connect. component_id is the smallest
    doc_id of the component. Texts that are missing, empty or without words have an
    empty set, linked with nothing. Rows without doc_id link with nothing, have no
    component_id and are kept. Rows that repeat a doc_id are compared each with its
    own text. A band proposes a pair at exactly 80 percent with probability 0.33, so
    that one such pair in 20,000 is not proposed by any.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    sketches = scratch.table(
        rows.mapInArrow(bounded(_sketch(words)), "doc_id long, n long, node binary, bands array<long>"), "sketches"
    )
    documents = sketches.count()
    # equal sets are one node
    nodes = sketches.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    ids = scratch.table(
        nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "nodes",
        documents,
    )
    banded = ids.select("node", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = scratch.table(banded.join(buckets, "key"), "members", BANDS * documents)
    shared = members.groupBy("node").agg(F.sum("members").alias("weight"))
    leaders = (
        members.join(shared, "node")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "node", "n")).alias("_l"))
        .select("key", F.col("_l.node").alias("leader"), F.col("_l.n").alias("leader_n"))
    )
    led = scratch.table(members.join(leaders, "key"), "led", BANDS * documents)
    scratch.drop(members)
    pairs = (
        led.where((F.col("node") != F.col("leader")) & _linkable(F.col("n"), F.col("leader_n"), percent))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    wanted = led.select("node").distinct().join(ids.select("node", "doc_id"), "node")
    sets = scratch.table(
        rows.join(wanted.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
        .select("node", "text")
        .mapInArrow(bounded(_sets(words)), "node binary, shingles array<long>")
        .dropDuplicates(["node"]),
        "sets",
        SET_FILES * documents,
    )

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y")), "b").join(
            sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), "a"
        )
        checked = both.select("a", "b", "_x", "_y").mapInArrow(bounded(_confirm(percent)), "a binary, b binary, linked boolean")
        return scratch.table(checked.where("linked").select("a", "b"), name, BANDS * documents)

    links = confirmed(pairs, "links")
    n_links = links.count()
    roots = components(links, scratch, n_links)
    more = scratch.table(_left_over(led, sets, roots, percent, scratch, documents), "more", BANDS * documents)
    n_more = more.count()
    if n_more:
        roots = components(links.unionByName(more), scratch, n_links + n_more)
    scratch.drop(led, sets)
    # a root is a node; its component's id is the smallest doc_id in it
    named = ids.join(roots, "node").select("node", "root", "doc_id")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("_component"))
    named = named.join(smallest, "root").select(F.col("node").alias("_node"), "_component")
    alone = ids.select(F.col("node").alias("_same"), F.col("doc_id").alias("_first"))
    known = alone.join(named, F.col("_same") == F.col("_node"), "left").select(
        F.col("_same").alias("_node"), F.coalesce("_component", "_first").alias("_component")
    )
    # many rows may share a node; all that have one and a doc_id are known
    named = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    rows = sketches.select("doc_id", "n", "node", named.alias("_named"))
    known = scratch.table(known, "components", documents)
    out = join_hot(rows.where("_named"), "node", known, "_node", documents).drop("_node")
    out = out.unionByName(rows.where("not _named").withColumn("_component", F.lit(None).cast("long")))
    component = F.coalesce("_component", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _compare_left(percent: int):
    """Links between the members of one block and those of another; each component that
    a member turns out to link with is met once."""

    def compare(table: pa.Table) -> pa.Table:
        cols = {k: table.column(k).to_pylist() for k in ("asks", "node", "root", "main")}
        n, c = table.column("n").to_numpy(), table.column("c").to_numpy()
        sets = _lists(table.column("shingles").combine_chunks())
        asks = np.array(cols["asks"], bool)
        asking, asked = np.flatnonzero(asks), np.flatnonzero(~asks)
        _, root = np.unique(np.array(cols["root"], object).astype("S16"), return_inverse=True)
        _, place = np.unique(np.array(cols["node"], object).astype("S16"), return_inverse=True)
        main = np.array(cols["main"], bool)
        a, b = [], []
        for i in asking.tolist():
            small, large = np.minimum(n[i], n[asked]), np.maximum(n[i], n[asked])
            fits = (100 + percent) * np.minimum(c[i], c[asked]) >= percent * (n[i] + n[asked])
            fits &= (100 * small >= percent * large) & (root[i] != root[asked]) & (main[asked] | (place[i] < place[asked]))
            met = set()
            for j in asked[fits].tolist():
                if root[j] in met:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    met.add(root[j])
                    a.append(cols["node"][i])
                    b.append(cols["node"][j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return compare


def _left_over(led: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, scratch: Scratch, documents: int) -> DataFrame:
    """Links (a, b) between components, among the nodes that share a leader.

    Nodes that share a bucket share its leader. A link of x needs
    (100 + percent) * c >= percent * (|x| + |y|), where c counts those shingles of x
    that occur in any other document left over. The largest component of a leader is
    only met by members of others. Comparisons run in blocks; only links leave them.
    """
    rest = led.where(F.col("node") != F.col("leader")).select("leader", "node", "n").distinct()
    rest = rest.join(roots, "node", "left").select("leader", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = rest.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("_m"))
    largest = (
        sizes.groupBy("leader")
        .agg(F.max(F.struct("_m", "root")).alias("_main"), F.count(F.lit(1)).alias("_roots"))
        .where("_roots > 1")
        .select("leader", F.col("_main.root").alias("_largest"))
    )
    rest = scratch.table(rest.join(largest, "leader").withColumn("main", F.col("root") == F.col("_largest")), "rest", BANDS * documents)
    left = sets.join(rest.select("node").distinct(), "node", "left_semi")
    single = (
        left.select("node", F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("node").alias("node"))
        .where("_c = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("_single"))
    )
    known = rest.join(single, "node", "left").withColumn("c", F.col("n") - F.coalesce("_single", F.lit(0)))
    # the partner has at least percent of the size
    known = known.where(100 * F.col("c") >= percent * F.col("n")).select("leader", "node", "n", "root", "main", "c")
    known = scratch.table(known, "known", BANDS * documents)
    blocks = (
        known.groupBy("leader")
        .agg(
            F.ceil(F.sum((~F.col("main")).cast("long")) / BLOCK).cast("int").alias("asking"),
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("asked"),
        )
        .where("asking > 0")
    )
    placed = known.join(blocks, "leader").join(sets, "node")
    kept = ("leader", "node", "n", "root", "main", "c", "shingles")
    ask = placed.where("not main").select(
        *kept, F.lit(True).alias("asks"),
        F.pmod(F.xxhash64("node"), "asking").cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("cb"),
    )
    asked = placed.select(
        *kept, F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("qb"),
        F.pmod(F.xxhash64("node"), "asked").cast("int").alias("cb"),
    )
    both = ask.unionByName(asked).groupBy("leader", "qb", "cb")
    return both.applyInArrow(_compare_left(percent), "a binary, b binary")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the documents that stay, one of each component, with all columns.

    Rows that repeat a doc_id stay together if one of them does.
    """
    kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias("_stays"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_stays"]), "left_semi")


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)
