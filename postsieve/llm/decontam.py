"""Finds benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingles.

The minimum of an item's shingles under a random order is a uniform draw from the item, so the share of its MinHash
shingles that a document has estimates how much of the item the document contains, however long the document is. (Comparing
two fixed signatures would need thousands of values: a short item in a long document has a Jaccard similarity near 0.)
Items are partitioned by size: up to PROBES shingles all are looked up; larger items have PROBES minima, and
the number that a document must have follows from the threshold and a tolerance.

The probes are a table. Documents are scanned once, however many items there are: their shingles pass a bit filter of the probes, and
those that may be one are joined to the table. Documents with enough probes of an item are its candidates, which are then verified on the words
themselves. Documents are known by a hash of their text on the way, so copies are looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, bounded_batches, hinted, packed, saved, unpacked
from .words import encoded, mixed, shingles, texts_words, word_hashes

PROBES = 32
#: Probability with which a contained item may be passed over by its minima.
TOLERANCE = 1e-9
#: The filter has this many bits for each probe, and at most 2 to this power: 32 MB, which each executor holds once. With more
#: probes than its bits can tell apart, more shingles reach the join, which stays exact.
FILTER_BITS, MOST_FILTER = 64, 28
#: Rows (of probes, candidates or documents to leave out) that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def least_hits(threshold: float, probes: int = PROBES, tolerance: float = TOLERANCE) -> int:
    """The most hits h of ``probes`` draws such that fewer have at most the tolerance as probability at the threshold."""
    below, h = 0.0, 0
    while below + (p := comb(probes, h) * threshold**h * (1 - threshold) ** (probes - h)) <= tolerance:
        below += p
        h += 1
    return h


def item_probes(text: str | None, k: int, threshold: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words in a shingle, weight that a document needs, probes, their weights) of an item; no probes without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return 0, 0, np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.unique(shingles(word_hashes([b" ".join(words)])[0], k))
    if len(h) <= PROBES:
        return min(k, len(words)), ceil(threshold * len(h) - 1e-9), h, np.ones(len(h), np.int64)
    least = [int(np.argmin(mixed(h ^ s))) for s in mixed(np.arange(1, PROBES + 1, dtype=np.uint64))]
    at, times = np.unique(least, return_counts=True)
    return min(k, len(words)), least_hits(threshold), h[at], times


def _probe_rows(k: int, threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for number, text in zip(part.column("number").to_pylist(), part.column("text").to_pylist(), strict=True):
                width, need, probes, weights = item_probes(text, k, threshold)
                rows += [(number, width, need, p, w) for p, w in zip(probes.view(np.int64).tolist(), weights.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["number", "width", "need", "probe", "weight"])

    return run


def _bit_filter(probes: DataFrame, n_probes: int) -> tuple[np.ndarray, int]:
    """A bit for the low bits of each probe, as bytes, and the number of these bits. Its size is bounded, and so is what the driver reads."""
    power = min(MOST_FILTER, max(10, (n_probes * FILTER_BITS - 1).bit_length()))
    low = F.col("probe").bitwiseAND(F.lit((1 << power) - 1))
    bytes_ = probes.groupBy(F.shiftright(low, 3).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), low.bitwiseAND(F.lit(7)).cast("int"))).cast("short").alias("bits"))
    found = bytes_.toArrow()
    out = np.zeros(1 << (power - 3), np.uint8)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return out, power


def candidates(rows: DataFrame, items: DataFrame, k: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """(crc_, items_): for each text hash, the items (number, text) that a text with this hash may contain. ``rows`` has crc and text; ``items``, a table, number and text, no text twice.

    The items of one text differ, and the text has most of the words of each."""
    spark = rows.sparkSession
    probes = saved(items.select("number", "text").mapInArrow(_probe_rows(k, threshold), "number long, width long, need long, probe long, weight long"), "decontam-probes")
    n_probes = probes.count()
    widths = sorted(r.width for r in probes.select("width").distinct().collect())  # k at most
    bits, power = _bit_filter(probes, n_probes)
    shared = spark.sparkContext.broadcast(bits)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        low = np.uint64((1 << power) - 1)
        for part in parts:
            at, found = [], []
            for row, words in texts_words(part.column("text")):
                h = np.concatenate([shingles(words, w) for w in widths if w <= len(words)] or [np.empty(0, np.uint64)])
                place = h & low
                h = np.unique(h[(table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                at += [row] * len(h)
                found.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("crc").take(pa.array(at, pa.int32())), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["crc", "probe"])

    met = rows.select("crc", "text").mapInArrow(scan, "crc long, probe long").distinct()
    hits = met.join(hinted(probes, n_probes, BROADCAST_ROWS), "probe").groupBy("crc", "number", "need").agg(F.sum("weight").alias("weight"))
    near = saved(hits.where("weight >= need").select(F.col("crc").alias("crc_"), "number"), "decontam-near")
    return saved(near.join(items, "number").groupBy("crc_").agg(F.collect_list(F.struct("number", "text")).alias("items_")), "decontam-candidates")


def _verified(k: int, threshold: float):
    """For each row, its text and its candidates: a row for each item text that the text contains. Shingles are found by their hashes and compared by their words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, which, shared, sizes = [], [], [], []
            first = 0
            lists, texts = part.column("items_"), encoded(part.column("text"))
            for row, text in enumerate(texts):
                own, hashes, grams = text.split(), word_hashes([text])[0], {}
                wanted = lists[row].as_py()
                items = [(item["text"] or "").encode("utf-8", "surrogatepass").split() for item in wanted]
                for n, words in enumerate(items):
                    w = min(k, len(words))
                    if w not in grams:
                        # of the text, only the shingles that an item has are looked at as words
                        known = np.unique(np.concatenate([shingles(word_hashes([b" ".join(x)])[0], w) for x in items if min(k, len(x)) == w]))
                        places = np.flatnonzero(np.isin(shingles(hashes, w), known)).tolist() if len(own) >= w else []
                        grams[w] = {tuple(own[i : i + w]) for i in places}
                    parts_ = {tuple(words[i : i + w]) for i in range(len(words) - w + 1)}
                    both = len(parts_ & grams[w])
                    if both >= threshold * len(parts_) - 1e-9:
                        at.append(row)
                        which.append(first + n)
                        shared.append(both)
                        sizes.append(len(parts_))
                first += len(wanted)
            names = lists.flatten().field(0)
            columns = [part.column("id").take(pa.array(at, pa.int32())), part.column("crc").take(pa.array(at, pa.int32())), names.take(pa.array(which, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "crc", "number", "shared", "item_shingles"])

    return run


def _contained(rows: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, crc, item, shared, item_shingles) of all pairs; ``rows`` has id, crc and text."""
    bounded_batches(rows.sparkSession)
    # texts are searched for; items that share a text take its finds at the end
    texts = saved(items.select("text").where("text is not null").distinct().withColumn("number", F.monotonically_increasing_id()), "decontam-texts")
    near = candidates(rows, texts, k, threshold)
    met = rows.join(hinted(near, near.count(), BROADCAST_ROWS), F.col("crc") == F.col("crc_")).select("id", "crc", "text", "items_")
    found = met.mapInArrow(_verified(k, threshold), f"id {dict(rows.dtypes)['id']}, crc long, number long, shared long, item_shingles long")
    named = saved(items.distinct().join(texts, "text").select("number", "item"), "decontam-items")
    return found.join(hinted(named, named.count(), BROADCAST_ROWS), "number").select("id", "crc", "item", "shared", "item_shingles")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("crc"), F.col(text_col).alias("text"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """(id, item, shared, item_shingles, containment): the pairs in which the document holds at least ``threshold`` of the item's shingles.

    An item of fewer than k words is one shingle of its own length. Null and empty texts and items without words are in no
    pair. Repeated documents give repeated rows; repeated items count once. Ids may be of any type; null ids are carried. Other columns are not
    looked at. An empty table on either side gives no rows.
    """
    found = _contained(_rows(docs, id_col, text_col), items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")), k, threshold)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. What holds for ``contained_items`` holds here; rows are known by their text."""
    rows = docs.select(F.octet_length(F.col(text_col)).alias("id"), F.xxhash64(F.col(text_col)).alias("crc"), F.col(text_col).alias("text"))
    found = _contained(rows, items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")), k, threshold)
    gone = saved(found.select(F.col("id").alias("gone_size_"), F.col("crc").alias("gone_crc_")).distinct(), "decontam-gone")
    tagged = docs.select(packed(docs), F.octet_length(F.col(text_col)).alias("size_"), F.xxhash64(F.col(text_col)).alias("crc_"))
    left = tagged.join(hinted(gone, gone.count(), BROADCAST_ROWS), (F.col("crc_") == F.col("gone_crc_")) & (F.col("size_") == F.col("gone_size_")), "left_anti")
    return left.select(*unpacked(docs.columns))
