"""Cross-entropy difference of two n-gram models that share one vocabulary.

The tokens are characters: the vocabulary is every character of the documents, with one entry for all unseen ones and one for
the boundary before a text. Both models are trigram models with the same smoothing over this vocabulary, one counted on the
target documents and one on all other documents (the background). The models are matched: background counts are scaled to as many tokens
as the target has, which is what samples of that size would have on average, so the smoothing weighs the same in both and no document is left out.
The score of a document is the mean over its tokens of target
loss minus background loss: below 0, it is more like the target than the rest of the corpus.

Counts cover every character of every document. They are tables of trigrams that grow with what the documents hold; none goes
through the driver. Documents are dealt into blocks of about BLOCK_BYTES. Each distinct trigram of a block is counted and,
later, joined to its losses once for the block; the block's documents then take theirs from those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hinted, saved
from .words import encoded

#: The least size of the vocabulary that the uniform prior is spread over. It grows beyond with the characters of the documents.
SYMBOLS = 128
#: The boundary, past the last code point; a trigram is three code points of BITS bits each in a long.
BOUNDARY = 0x110000
BITS = 21
#: Weight, in counts, of the next lower order in the smoothed probabilities.
PRIOR = 8.0
#: Bytes of text from which a block is full. A longer text is in one block with those that begin the block.
BLOCK_BYTES = 1 << 20
#: Ids of target documents that may be broadcast to the count (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a count or loss table that may be broadcast (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the texts (each preceded by two boundaries), and the number of each text's."""
    parts = [np.frombuffer(t.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    points = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    place = np.arange(len(points)) + 2 * np.repeat(np.arange(1, len(texts) + 1), lengths)
    symbols = np.full(len(points) + 2 * len(texts), BOUNDARY, np.int64)
    symbols[place] = points
    return (symbols[place - 2] << 2 * BITS) | (symbols[place - 1] << BITS) | symbols[place], lengths


def blocks(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (id, text, target, block) of ``docs``, as a table. ``targets`` has the ids, distinct."""
    targets = targets.select(F.col(id_col).alias("target_id"), F.lit(True).alias("target"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(hinted(targets, targets.count(), BROADCAST_IDS), F.col("id") == F.col("target_id"), "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for part in parts:
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first + starts // BLOCK_BYTES, pa.int64())], names=["id", "text", "target", "block"])

    kind = dict(rows.dtypes)["id"]
    return saved(rows.mapInArrow(deal, f"id {kind}, text string, target boolean, block long"), "lm-blocks")


def block_counts(rows: DataFrame) -> DataFrame:
    """(block, cell, n_target, n_all) for the distinct trigrams of the blocks, as a table. A block that is read in parts has rows for each."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (x for part in parts for x in zip(part.column("block").to_pylist(), part.column("target").to_pylist(), encoded(part.column("text")), strict=True))
        for block, members in groupby(read, lambda x: x[0]):
            _, flags, texts = zip(*members, strict=True)
            found, lengths = _trigrams(list(texts))
            cells, n = np.unique(found, return_counts=True)
            chosen, n_chosen = np.unique(found[np.repeat(np.array(flags, bool), lengths)], return_counts=True)
            n_target = np.zeros(len(cells), np.int64)
            n_target[np.searchsorted(cells, chosen)] = n_chosen
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), block, np.int64)), pa.array(cells), pa.array(n_target), pa.array(n.astype(np.int64))], names=["block", "cell", "n_target", "n_all"])

    return saved(rows.select("block", "target", "text").mapInArrow(count, "block long, cell long, n_target long, n_all long"), "lm-block-counts")


def losses(counts: DataFrame) -> DataFrame:
    """(cell, target, background) for each trigram of ``counts`` (cell, n_target, n_rest), as a table: the loss in nats of its last character in
    both models. Each order is mixed with the next lower one."""
    mask = lambda n: F.lit((1 << n * BITS) - 1)
    cell = F.col("cell")
    models = ("target", "rest")

    def summed(df: DataFrame, key: Column, name: str, prefix: str) -> DataFrame:
        return df.groupBy(key.alias(name)).agg(*[F.sum(f"n_{m}").alias(f"{prefix}_{m}") for m in models])

    pairs = saved(counts.groupBy(cell.bitwiseAND(mask(2)).alias("cell")).agg(*[F.sum(f"n_{m}").alias(f"n_{m}") for m in models]), "lm-pairs")
    single = saved(summed(pairs, cell.bitwiseAND(mask(1)), "last", "n1"), "lm-characters")
    known = single.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"n1_{m}"), F.lit(0)).alias(m) for m in models]).first()
    symbols = max(SYMBOLS, known.n + 2)
    scale = {"target": F.lit(1.0), "rest": F.lit(known.target / known.rest if known.rest else 0.0)}
    times = lambda prefix, m: scale[m] * F.col(f"{prefix}_{m}")
    # both have as many tokens, but for a corpus without other documents
    tokens = {"target": known.target, "rest": known.target if known.rest else 0}
    p1 = {m: (times("n1", m) + 1) / F.lit(float(tokens[m] + symbols)) for m in models}
    before = summed(pairs, F.shiftright(cell, BITS), "first", "c1")
    two = pairs.join(hinted(single, known.n, BROADCAST_ROWS), cell.bitwiseAND(mask(1)) == F.col("last"))
    two = two.join(hinted(before, known.n, BROADCAST_ROWS), F.shiftright(cell, BITS) == F.col("first"))
    two = two.select(cell.alias("pair"), *[((times("n", m) + PRIOR * p1[m]) / (times("c1", m) + PRIOR)).alias(f"p2_{m}") for m in models])
    three = counts.join(two, cell.bitwiseAND(mask(2)) == F.col("pair")).join(summed(counts, F.shiftright(cell, BITS), "context", "c2"), F.shiftright(cell, BITS) == F.col("context"))
    loss = {m: -F.log((times("n", m) + PRIOR * F.col(f"p2_{m}")) / (times("c2", m) + PRIOR)) for m in models}
    return saved(three.select("cell", loss["target"].alias("target"), loss["rest"].alias("background")), "lm-losses")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, difference) for each row of ``docs``; losses are means in nats per token.

    ``targets`` has the ids of the target documents; repeated and null ids in it do nothing, ids that are not in ``docs`` neither. With no
    target document both models are the uniform prior, and where all are target documents the background is. A null or empty text has no tokens and null losses.
    Repeated rows are counted and scored as often as they occur. Other columns are not looked at. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    wanted = targets.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()
    rows = blocks(docs, wanted, id_col, text_col)
    counted = block_counts(rows)
    cells = saved(counted.groupBy("cell").agg(F.sum("n_target").alias("n_target"), (F.sum("n_all") - F.sum("n_target")).alias("n_rest")), "lm-counts")
    table = losses(cells)
    known = counted.select("block", "cell").join(hinted(table, table.count(), BROADCAST_ROWS), "cell").select("block", "cell", "target", "background")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        cells = known.column("cell").to_numpy()
        order = np.argsort(cells)
        found, n = _trigrams(encoded(texts.column("text")))
        at = order[np.searchsorted(cells, found, sorter=order)] if len(found) else found
        row = np.repeat(np.arange(len(n)), n)
        means = [np.round(np.bincount(row, known.column(m).to_numpy()[at], len(n)) / np.maximum(n, 1), 6) for m in ("target", "background")]
        columns = [pa.array(m, mask=n == 0) for m in (*means, means[0] - means[1])]
        return pa.Table.from_arrays([texts.column("id"), pa.array(n), *columns], names=["id", "n_tokens", "target_loss", "background_loss", "difference"])

    kind = dict(rows.dtypes)["id"]
    both = rows.select("block", "id", "text").groupBy("block").cogroup(known.groupBy("block"))
    return both.applyInArrow(score, f"id {kind}, n_tokens long, target_loss double, background_loss double, difference double").withColumnRenamed("id", id_col)
