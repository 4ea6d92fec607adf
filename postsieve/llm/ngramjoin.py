"""Self-join of texts on the Jaccard similarity of their word shingles, with Bayesian candidate pruning.

1. Every text gets the set of its shingles, a fingerprint of that set (its node) and keys of MinHash bands. Texts with equal sets are one node.
2. Nodes that share a band key are candidates. Of the buckets of nodes that hold the same nodes, one is kept; a pair that shares
   several kept buckets is compared in the first of them only. Nodes that share no bucket are never compared.
3. Within a bucket, MinHash values are compared some at a time. A pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below a tolerance. The rest is verified exactly.
   Large buckets are dealt out in pairs of blocks, bounded in texts and bytes, so a task never holds more than two blocks, and only
   counts and a spanning forest leave it: no list of pairs is ever made.
4. Each node is tied to the smallest root that it was found with, and these roots among themselves. Components of the ties are the classes.

A pair at the threshold is missed by all bands with probability (1 - 0.8^6)^40 = 5e-6, and pruned with the tolerance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SHINGLE_WORDS, SIMILARITY, bounded_batches, hinted, packed, saved, unpacked
from .components import components
from .words import mixed, shingles, texts_words

BANDS, BAND_ROWS = 40, 6
HASHES = BANDS * BAND_ROWS
#: MinHash values compared between two looks at the posterior.
STEP = 16
#: A pair is pruned when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: About the most texts and bytes (signatures and shingles) in a block of a large bucket; two blocks are compared at once.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 16 << 20
#: Rows (an id, two hashes) that may be broadcast to a scan of the texts; beyond, they are joined by a shuffle.
BROADCAST_IDS = 200_000
#: The low bits of a band key hold the number of its band.
BAND_BITS = (1 << (BANDS - 1).bit_length()) - 1

_seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FLIP = (_seeds[:HASHES] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_seeds[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(distinct: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (uint32) of a set of shingle hashes."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    h = (distinct >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 512):
        x = (h[i : i + 512, None] ^ _FLIP) * _TIMES
        x ^= x >> np.uint32(15)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key (int64) for each band of a signature; its low bits are the number of the band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    rows = low.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    for j in range(BAND_ROWS):
        key = mixed((key ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15))
    return ((key & np.uint64(~BAND_BITS & (1 << 64) - 1)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def needed(threshold: float = SIMILARITY, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: the fewest equal ones with which a pair stays.

    With a uniform prior, m of n equal values give the posterior Beta(m + 1, n - m + 1). Its tail above
    the threshold is a binomial sum.
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail = sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        found.append(m)
    return found


def _node(distinct: np.ndarray) -> bytes:
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


_KEYED = "id long, crc long, node binary, short long, n_shingles long, bands array<long>"


def _keyed(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes, shorts, sizes, bands = [], [], [], []
            for _, words in texts_words(part.column("text")):
                distinct = np.unique(shingles(words, k))
                sizes.append(len(distinct))
                nodes.append(_node(distinct) if len(distinct) else None)
                shorts.append(_short(nodes[-1]) if len(distinct) else None)
                bands.append(band_keys(signature(distinct)) if len(distinct) else np.empty(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
            made = [pa.array(nodes, pa.binary()), pa.array(shorts, pa.int64()), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("crc"), *made], names=["id", "crc", "node", "short", "n_shingles", "bands"])

    return run


_PAYLOAD = pa.schema([("node", pa.binary()), ("short", pa.int64()), ("copies", pa.int64()), ("buckets", pa.list_(pa.int64())), ("low", pa.binary()), ("sh", pa.binary())])


def _payload(k: int):
    """Signature and shingles of candidate texts; a row whose text is not the one that the node stands for goes (a collision of text hashes)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            node = part.column("node").to_pylist()
            at, low, sh = [], [], []
            for row, words in texts_words(part.column("text")):
                distinct = np.unique(shingles(words, k))
                if len(distinct) and _node(distinct) == node[row]:
                    at.append(row)
                    low.append(signature(distinct).tobytes())
                    sh.append(distinct.tobytes())
            kept = [part.column(c).take(pa.array(at, pa.int32())) for c in ("node", "short", "copies", "buckets")]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, pa.array(low, pa.binary()), pa.array(sh, pa.binary())], _PAYLOAD, strict=True)], schema=_PAYLOAD)

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a[i], b[j]) of sorted distinct arrays."""
    vocabulary = sum(map(len, a)) + sum(map(len, b))
    if len(i) * 25e-6 < len(a) * len(b) * vocabulary * 4e-11 + 1e-3:
        out = np.empty(len(i), np.int64)
        for n, (x, y) in enumerate(zip(i, j, strict=True)):
            s, t = (a[x], b[y]) if len(a[x]) <= len(b[y]) else (b[y], a[x])
            out[n] = (t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()
        return out
    _, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts, wide = np.zeros((len(a), len(b)), np.float64), 8192
    for first in range(0, int(column[-1]) + 1, wide):
        lo, hi = np.searchsorted(column, (first, first + wide))
        there = np.zeros((len(a) + len(b), wide), np.float32)
        there[row[lo:hi], column[lo:hi] - first] = 1
        counts += there[: len(a)] @ there[len(a) :].T
    return counts[i, j].astype(np.int64)


def linked_pairs(low_a, low_b, sh_a: list[np.ndarray], sh_b: list[np.ndarray], same: bool, threshold: float, need: list[int], known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of the two blocks that reach the threshold; i < j where the blocks are the same.

    ``known``: for each text, its bucket in each earlier band, or 0. A pair that shares one of them has been compared there and is left out.
    """
    equal = np.zeros((len(low_a), len(low_b)), np.int16)
    for c in range(STEP):
        equal += low_a[:, c, None] == low_b[None, :, c]
    size_a, size_b = (np.array([len(x) for x in s], np.int64) for s in (sh_a, sh_b))
    left = (equal >= need[0]) & (np.minimum(size_a[:, None], size_b) >= threshold * np.maximum(size_a[:, None], size_b) - 1e-9)
    i, j = np.nonzero(np.triu(left, 1) if same else left)
    # some pairs at a time, as two blocks may have very many
    some = [slice(p, p + 20_000) for p in range(0, len(i), 20_000)]
    if known is not None and len(i):
        new = np.concatenate([~((known[0][i[p]] == known[1][j[p]]) & (known[0][i[p]] != 0)).any(1) for p in some])
        i, j = i[new], j[new]
    m = equal[i, j].astype(np.int64)
    for step in range(1, len(need)):
        if not len(i):
            break
        at = slice(step * STEP, (step + 1) * STEP)
        m += np.concatenate([(low_a[i[p : p + 20_000], at] == low_b[j[p : p + 20_000], at]).sum(1) for p in range(0, len(i), 20_000)])
        stay = m >= need[step]
        i, j, m = i[stay], j[stay], m[stay]
    if len(i):
        shared = _common(sh_a, sh_b, i, j)
        reach = shared >= threshold * (size_a[i] + size_b[j] - shared) - 1e-9
        i, j = i[reach], j[reach]
    return i, j


_FOUND = "node binary, links long, root binary"


def _compared(rows: list[tuple], pair: tuple[int, int, int], threshold: float, need: list[int]) -> list[tuple[bytes, int, bytes]]:
    """(node, links, root) of the nodes of two blocks that have links; root is the smallest node that is reached over them.

    ``rows``: (block, node, copies, buckets, low, sh); ``pair``: the bucket and its two blocks."""
    bucket, first, second = pair
    rows.sort(key=lambda r: r[1])
    a = [r for r in rows if r[0] == first]
    b = a if second == first else [r for r in rows if r[0] == second]
    if not a or not b or len(rows) < 2:
        return []
    band = bucket & BAND_BITS

    def earlier(block: list[tuple]) -> np.ndarray:
        out = np.zeros((len(block), band), np.int64)
        for n, r in enumerate(block):
            for x in r[3]:
                if x & BAND_BITS < band:
                    out[n, x & BAND_BITS] = x
        return out

    low = [np.array([np.frombuffer(r[4], np.uint32) for r in x]) for x in (a, b)]
    sh = [[np.frombuffer(r[5], np.uint64) for r in x] for x in (a, b)]
    i, j = linked_pairs(*low, *sh, a is b, threshold, need, (earlier(a), earlier(b)))
    every = a if a is b else a + b
    if a is not b:
        j = j + len(a)
    weight, links = np.array([r[2] for r in every], np.int64), np.zeros(len(every), np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    names = [r[1] for r in every]
    order = np.argsort(np.argsort(np.array(names, object)))  # the place of each node in the order of nodes
    root = order.copy()
    while len(i):
        least, was = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        if (was == root).all():
            break
    name_at = sorted(names)
    return [(names[n], int(links[n]), name_at[root[n]]) for n in np.flatnonzero(links)]


def _compare(threshold: float):
    """For rows sorted by bucket and blocks: the links of each pair of blocks, one pair after the other."""
    need = needed(threshold)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part in parts:
            done = []
            names = ("band", "i", "j", "block", "node", "copies", "buckets", "low", "sh")
            for bucket, i, j, *row in zip(*(part.column(x).to_pylist() for x in names), strict=True):
                if now != (bucket, i, j):
                    done += _compared(held, now, threshold, need) if now else []
                    now, held = (bucket, i, j), []
                held.append(tuple(row))
            yield _links(done)
        yield _links(_compared(held, now, threshold, need) if now else [])

    return run


def _links(found: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    node, links, root = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(links, pa.int64()), pa.array(root, pa.binary())], names=["node", "links", "root"])


def _rep(*columns: str) -> Column:
    """A row's (id, text hash) in an order that has null ids last."""
    id_, crc = columns
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(crc).alias("crc"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _fetched(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (node, id, crc, ...) with the text of a row by that id and text hash. Hash and id both have to fit, so rows that share an
    id, or have none, are not multiplied."""
    names = [c for c in chosen.columns if c not in ("id", "crc")]
    wanted = chosen.select(*names, F.col("id").alias("id_"), F.col("crc").alias("crc_"))
    met = rows.join(hinted(wanted, wanted.count(), BROADCAST_IDS), rows["id"].eqNullSafe(wanted["id_"]) & (rows["crc"] == wanted["crc_"]))
    return met.select(*names, "text").dropDuplicates(["node"])


def _classes(rows: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(seen, info): seen has the id, text hash (crc), node and n_shingles of each row; info has each node's links and
    the representative of its class: the smallest (id, crc), null ids last."""
    seen = saved(rows.mapInArrow(_keyed(k), _KEYED), "join-keys")
    there = seen.where("node is not null")
    nodes = there.groupBy("node", "short").agg(F.min(_rep("id", "crc")).alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = saved(nodes, "join-nodes")
    bands = nodes.select("short", F.explode("bands").alias("band"))
    # a bucket's number of nodes and two hashes of the set of its nodes
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor("short").alias("x"), F.bit_xor(F.xxhash64("short")).alias("y")).where("n > 1")
    kept = buckets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
    members = saved(bands.join(kept, "band"), "join-members")
    mine = members.groupBy("short").agg(F.collect_list("band").alias("buckets"))
    chosen = saved(nodes.join(mine, "short").select("node", "short", "copies", "buckets", "n_shingles", "rep.id", "rep.crc"), "join-chosen")
    payload = saved(_fetched(rows, chosen.drop("n_shingles")).mapInArrow(_payload(k), "node binary, short long, copies long, buckets array<long>, low binary, sh binary"), "join-payload")

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = chosen.select(F.explode("buckets").alias("band"), (F.col("n_shingles") * 8 + HASHES * 4).alias("bytes")).groupBy("band")
    sizes = sizes.agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    # only large buckets have rows here; the rest is one block
    sizes = saved(sizes.where("n_blocks > 1"), "join-sizes")
    dealt = payload.withColumn("band", F.explode("buckets")).join(sizes, "band", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "buckets", "low", "sh")
    dealt = dealt.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    found = saved(dealt.mapInArrow(_compare(threshold), _FOUND), "join-found")

    roots = saved(found.select("node", "root").distinct().withColumn("hub", F.min("root").over(Window.partitionBy("node"))), "join-roots")
    ties = roots.select(F.col("node").alias("a"), F.col("hub").alias("b")).union(roots.where("root <> hub").select("root", "hub")).where("a <> b").distinct()
    classes = components(ties, "join-classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "rep", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    info = saved(info, "join-info")
    named = info.groupBy("component").agg(F.min("rep").alias("first"))
    return seen.drop("bands", "short"), saved(info.join(named, "component").select("node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links")), "join-named")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("crc"), F.col(text_col).alias("text"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: (id, class_id, n_links, n_shingles), the id under its own name.

    n_links: other rows whose shingle set has a Jaccard similarity of at least ``threshold`` (thresholds well below
    0.8 would need other bands). class_id: the smallest id that can be reached over links. Words are runs of
    characters other than ASCII white space. A text of fewer than k words is one shingle. A null text or one
    without words has no shingles and no links, and is its own class. Repeated rows link to each other; rows
    that share an id but not a text are told apart by their texts. A null id takes part, but never names a
    class while another id does. Ids are whole numbers. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    seen, info = _classes(_rows(docs, id_col, text_col), k, threshold)
    out = seen.select("id", "node", "n_shingles").join(info, "node", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
    )


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with their columns, of which one stays for each class of the join: that with the smallest id, null ids last, and of
    rows that share this id the one with the smallest hash of its text.

    A row is known by its id and text, so a text that only shares an id with a copy stays. Of rows with one id and one text, the one whose
    other columns come first in their written form stays. Rows without words are in no class and stay, all of them. Empty tables are allowed.
    """
    bounded_batches(docs.sparkSession)
    seen, info = _classes(_rows(docs, id_col, text_col), k, threshold)
    met = seen.where("node is not null").join(info.select("node", F.col("first.id").alias("first_id"), F.col("first.crc").alias("first_crc")), "node")
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("crc") == F.col("first_crc"))
    marks = met.groupBy("id", "crc", stays.alias("stays")).agg(F.count("*").alias("n")).where("not stays or n > 1")
    marks = saved(marks.select(F.col("id").alias("id_"), F.col("crc").alias("crc_"), "stays"), "join-marks")
    rows = docs.select(packed(docs), F.col(id_col).cast("long").alias("own_id_"), text_hash(F.col(text_col)).alias("own_crc_"))
    rows = rows.join(hinted(marks, marks.count(), BROADCAST_IDS), F.col("own_id_").eqNullSafe(F.col("id_")) & (F.col("own_crc_") == F.col("crc_")), "left")
    others = [F.col(f"row_.`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    written = F.to_json(F.struct(*others)) if others else F.lit("")
    # repeated rows that stay are few: copies under other ids are gone
    repeated = rows.where("stays").groupBy("own_id_", "own_crc_").agg(F.min_by("row_", written).alias("row_"))
    return rows.where("crc_ is null").select(*unpacked(docs.columns)).unionByName(repeated.select(*unpacked(docs.columns)))
