"""Ranked lexical search by pipelined term partitioning.

1. Texts are scanned once: their number of terms, and how often each term of the items occurs. A bounded bit filter of the items' terms keeps other terms back.
2. Terms get whole-number weights from their document counts. Owners share the terms out by weight, the rarest to the first owner, so that each owns
   about as many postings.
3. Documents are dealt into blocks and items into bundles. For each block a bundle travels from owner to owner: every stage cogroups the bundle, which carries sparse
   accumulators of its documents, with the owner's postings of that block, and adds whole-number contributions.
4. Between stages, the tenth best sum of each item over all blocks is known. An accumulator goes, or is not begun, once all that later owners could add would leave it
   below that sum; what stays at the end has its exact score. Ties stay until the final selection, which orders them by id.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, saved, scratch, small_batches
from .words import encoded

#: A term is a run of ASCII letters and digits and of characters that are not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Documents of an item's result, term owners, items of a bundle and documents of a block (about).
TOP, OWNERS, BUNDLE_ITEMS, BLOCK_DOCS = 10, 4, 256, 8192
#: Bits of the filter of the items' terms.
FILTER_BITS = 1 << 22
#: Rows (a term or an item, some numbers) that may be broadcast.
BROADCAST_ROWS = 200_000


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, as an array; empty for null."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM + "+"), 0)
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def term_counts(text: bytes) -> Counter:
    """The terms of a text in UTF-8 and how often each occurs."""
    return Counter(text.translate(_BYTES).split())


_SCANNED = "row long, doc_id long, n long, terms array<string>, tfs array<long>"


def _scanned(bits: bytes):
    """The number of terms of each text, and those that may be a term of an item with their occurrences."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, hashed = FILTER_BITS - 1, zlib.crc32
        for part in parts:
            n, terms, tfs, ends = [], [], [], [0]
            for text in encoded(part.column("text")):
                counts = term_counts(text)
                n.append(sum(counts.values()))
                for term, tf in counts.items():
                    h = hashed(term) & mask
                    if bits[h >> 3] >> (h & 7) & 1:
                        terms.append(term.decode("utf-8", "replace"))
                        tfs.append(tf)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "tfs"])

    return run


def _filter_bits(terms: DataFrame) -> bytes:
    """A bit filter of the terms. Its positions are at most FILTER_BITS, whatever the number of terms."""
    places = terms.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS)).alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)
    bits = np.zeros(FILTER_BITS, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """What one occurrence count of a term in a document of n terms counts for, before the term's weight; below 10^6."""
    # whole numbers throughout: div rounds down
    m = F.lit(10) + F.call_function("div", n * F.lit(90) * F.lit(n_docs), F.lit(n_terms))
    return F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * m)


def _owned(terms: DataFrame) -> Column:
    """The owner of a term by its weight, from 1: owners have about as many postings, and the first has the terms of the largest weights."""
    volume = sorted(((r.w, r.df) for r in terms.groupBy("w").agg(F.sum("df").alias("df")).collect()), reverse=True)  # weights are whole numbers below 10^5
    total, given, cuts = sum(df for _, df in volume), 0, []
    for w, df in volume:
        given += df
        if given * OWNERS >= total * (len(cuts) + 1):
            cuts.append(w)
    owner = F.lit(1)
    for w in cuts[: OWNERS - 1]:
        owner = owner + (F.col("w") < w).cast("int")
    return owner


_STATE = "bundle int, block int, query array<struct<item:long,tid:long,owner:int,w:long,most:long>>, acc_item array<int>, acc_row array<long>, acc_score array<long>, best_item array<int>, best array<long>"


_QUERY = pa.list_(pa.struct([("item", pa.int64()), ("tid", pa.int64()), ("owner", pa.int32()), ("w", pa.int64()), ("most", pa.int64())]))
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_SCHEMA = pa.schema([("bundle", pa.int32()), ("block", pa.int32()), ("query", _QUERY), ("acc_item", _INTS), ("acc_row", _LONGS), ("acc_score", _LONGS), ("best_item", _INTS), ("best", _LONGS)])


def _numbers(table: pa.Table, column: str, kind) -> np.ndarray:
    """The elements of the array in the only row of ``table``."""
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)


def _stage(owner: int):
    """One owner's turn with a bundle: its accumulators of a block's documents, and the owner's postings of that block."""

    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            return _SCHEMA.empty_table()
        asked = bundle.column("query").combine_chunks().flatten()
        query = {c: asked.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("item", "tid", "owner", "w", "most")}
        items, of = np.unique(query["item"], return_inverse=True)
        later = np.bincount(of, query["most"] * (query["owner"] > owner), len(items))
        still = np.bincount(of, query["most"] * (query["owner"] >= owner), len(items))
        floor = np.zeros(len(items))
        known, sums = (_numbers(bundle, c, np.int64) for c in ("floor_item", "floor"))
        floor[np.searchsorted(items, known)] = sums
        acc_item, acc_row, acc_score = (_numbers(bundle, f"acc_{c}", np.int64) for c in ("item", "row", "score"))
        tids, docs, counted = (postings.column(c).to_numpy() for c in ("tid", "row", "impact"))
        order = np.argsort(tids, kind="stable")
        tids, docs, counted = tids[order], docs[order], counted[order].astype(np.int64)
        rows, at = np.unique(np.concatenate([acc_row, docs]), return_inverse=True)
        sums = np.zeros((len(items), len(rows)), np.int64)
        sums[acc_item, at[: len(acc_row)]] = acc_score
        begun = sums > 0
        at = at[len(acc_row) :]
        mine = np.flatnonzero(query["owner"] == owner)
        mine = mine[np.argsort(query["tid"][mine], kind="stable")]
        wanted, first = np.unique(query["tid"][mine], return_index=True)
        lo, hi = np.searchsorted(tids, wanted, "left"), np.searchsorted(tids, wanted, "right")
        for k, until, a, b in zip(first.tolist(), np.append(first, len(mine))[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
            if b > a:
                sums[np.ix_(of[mine[k:until]], at[a:b])] += query["w"][mine[k]] * counted[a:b]
        # an accumulator may not begin here where all that is still to come is too little
        sums[(still < floor)[:, None] & ~begun] = 0
        top = min(TOP, len(rows))
        best = -np.sort(-np.partition(sums, len(rows) - top, axis=1)[:, len(rows) - top :], axis=1) if top else np.zeros((len(items), 0), np.int64)
        if top == TOP:
            floor = np.maximum(floor, best[:, -1])
        stay, where = np.nonzero((sums > 0) & (sums + later[:, None] >= floor[:, None]))
        best_item = np.repeat(np.arange(len(items)), best.shape[1])
        positive = best.ravel() > 0
        made = {"acc_item": stay.astype(np.int32), "acc_row": rows[where], "acc_score": sums[stay, where], "best_item": best_item[positive].astype(np.int32), "best": best.ravel()[positive]}
        out = {c: bundle.column(c) for c in ("bundle", "block", "query")}
        return pa.table(out | {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for c, v in made.items()}).cast(_SCHEMA)

    return run


def _floors(state: DataFrame) -> DataFrame:
    """(bundle, floor_item, floor): the tenth best sum of each item over all blocks, where there are ten. Few rows of each task are shuffled."""
    best = state.select("bundle", F.explode(F.arrays_zip("best_item", "best")).alias("x")).select("bundle", "x.*")
    tenth = best.withColumn("k", F.row_number().over(Window.partitionBy("bundle", "best_item").orderBy(F.desc("best")))).where(F.col("k") <= TOP).where(F.col("k") == TOP)
    items = state.dropDuplicates(["bundle"]).select("bundle", F.array_sort(F.array_distinct(F.col("query.item"))).alias("items"))
    found = tenth.join(items, "bundle").select("bundle", F.struct(F.get("items", F.col("best_item")).alias("item"), F.col("best").alias("floor")).alias("f"))
    return found.groupBy("bundle").agg(F.collect_list("f").alias("f")).select("bundle", F.col("f.item").alias("floor_item"), F.col("f.floor").alias("floor"))


def _postings(scanned: DataFrame, terms: DataFrame, n_terms_known: int, n_docs: int, n_terms: int, blocks: int) -> DataFrame:
    each = scanned.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", "n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    each = each.join(hinted(terms.select("term", "tid", "owner"), n_terms_known, BROADCAST_ROWS), "term")
    return each.select("owner", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "tid", "row", impact(F.col("tf"), F.col("n"), n_docs, n_terms).cast("int").alias("impact"))


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item id, rank, document id, score): for each row of ``items`` the TOP documents with the highest scores above zero; equal scores by ascending id, null ids last.

    A null or empty text has no terms: such a document is never found and not counted, such an item finds nothing. Repeated documents are documents of their own. Items
    of one id and text are one item; an id with several texts is ranked for each of them. Document ids are whole numbers. Other columns are not looked at. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    asked = saved(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", terms_of(F.col("text")).alias("terms")).where(F.size("terms") > 0), "lexical-items")
    n_items = asked.count()
    item_terms = asked.select("item", F.explode("terms").alias("term"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(spark):
        scanned = saved(rows.mapInArrow(_scanned(_filter_bits(item_terms)), _SCANNED), "lexical-scanned")
    whole = scanned.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count("*").alias("rows")).first()
    n_docs, n_terms = whole["docs"], max(1, whole["terms"])
    blocks, bundles = max(1, -(-whole["rows"] // BLOCK_DOCS)), max(1, -(-n_items // BUNDLE_ITEMS))

    df = scanned.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(item_terms.select("term").distinct(), "term")
    terms = saved(df.select("term", "df", weight(n_docs, F.col("df")).alias("w"), F.monotonically_increasing_id().alias("tid")), "lexical-terms")
    terms, known = terms.withColumn("owner", _owned(terms)), terms.count()
    path = scratch(spark, "lexical-postings")
    _postings(scanned, terms, known, n_docs, n_terms, blocks).write.partitionBy("owner").parquet(path)
    postings = spark.read.schema("block int, tid long, row long, impact int, owner int").parquet(path)
    most = postings.groupBy("tid").agg(F.max("impact").alias("most"))
    placed = item_terms.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
    placed = placed.join(hinted(terms, known, BROADCAST_ROWS), "term").join(hinted(most, known, BROADCAST_ROWS), "tid")
    placed = saved(placed.select("bundle", "item", "tid", "owner", "w", (F.col("w") * F.col("most")).alias("most")), "lexical-queries")

    empty = {c: F.array().cast(f"array<{t}>").alias(c) for c, t in (("acc_item", "int"), ("acc_row", "long"), ("acc_score", "long"), ("best_item", "int"), ("best", "long"))}
    state = placed.groupBy("bundle").agg(F.collect_list(F.struct("item", "tid", "owner", "w", "most")).alias("query"))
    state = state.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "query", *empty.values())
    none = spark.createDataFrame([], "bundle int, floor_item array<long>, floor array<long>")
    for owner in range(1, OWNERS + 1):
        floors = saved(_floors(state), "lexical-floors") if owner > 1 else none
        carried = state.join(hinted(floors, bundles, BROADCAST_ROWS // BUNDLE_ITEMS), "bundle", "left")
        carried = carried.withColumns({c: F.coalesce(c, F.array().cast("array<long>")) for c in ("floor_item", "floor")})
        mine = placed.where(F.col("owner") == owner).select(F.col("bundle").alias("to"), "tid").distinct()
        met = postings.where(F.col("owner") == owner).join(hinted(mine, known if bundles == 1 else BROADCAST_ROWS + 1, BROADCAST_ROWS), "tid").select(F.col("to").alias("bundle"), "block", "tid", "row", "impact")
        keys = ["bundle", "block"]
        state = saved(carried.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(_stage(owner), _STATE), "lexical-bundles")

    found = state.select("bundle", F.array_sort(F.array_distinct(F.col("query.item"))).alias("items"), F.explode(F.arrays_zip("acc_item", "acc_row", "acc_score")).alias("x"))
    found = found.select(F.get("items", F.col("x.acc_item")).alias("item"), F.col("x.acc_row").alias("row"), F.col("x.acc_score").alias("score"))
    floors = _floors(state).select(F.explode(F.arrays_zip("floor_item", "floor")).alias("x")).select(F.col("x.floor_item").alias("item"), F.col("x.floor").alias("floor"))
    found = saved(found.join(hinted(floors, n_items, BROADCAST_ROWS), "item", "left").where(F.col("score") >= F.coalesce("floor", F.lit(1))).drop("floor"), "lexical-found")
    named = scanned.select("row", "doc_id").join(hinted(found, found.count(), BROADCAST_ROWS), "row")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    ranked = ranked.join(hinted(asked.select("item", "item_id"), n_items, BROADCAST_ROWS), "item")
    return ranked.select(F.col("item_id").alias(item_id_col), "rank", F.col("doc_id").alias(id_col), "score")
