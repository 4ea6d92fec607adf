"""Near copies by SimHash fingerprints, found with deletion-variant signatures.

1. A text's fingerprint has 64 bits: a bit is set where over half of the hashes of its word shingles have it, repeats counted.
2. Two fingerprints within four bits are cut into three segments, so one segment differs by one bit at most. Each fingerprint is indexed under its
   segments as they are, and under every variant of a segment with one bit as a wildcard; fingerprints that meet under one key are compared.
   Under a wildcard only those with different bits at its place meet, as the others meet under the segment itself.
3. Keys are an equality exchange. Where a segment's value is common, the rows of its keys are dealt out in pairs of blocks, so no task holds more than two
   blocks. What leaves a task is a forest of the links found, never all pairs of a group.
4. Connected components of the forests are the groups. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, saved, small_batches
from .components import components
from .words import encoded

#: Words of a shingle, the seed of its hash, and the bits in which linked fingerprints may differ.
WORDS, SEED, MOST_BITS = 4, 42, 4
#: First bit and width of each segment. There are enough for one of them to differ by one bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a block, and rows of values that may be broadcast (a segment, its value, a number).
BLOCK, BROADCAST_VALUES = 4096, 200_000
#: Shingles that are counted at a time.
_SOME = 1 << 16
#: Rows that are compared as one sorted run of small groups, and the size from which a group is compared as a matrix.
_RUN, _LARGE = 1 << 18, 64


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8; zero without words."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    n = len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    hashed, set_ = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _SOME):
        h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[i : i + _SOME], ends[i : i + _SOME], strict=True)), np.uint64)
        set_ += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * set_ > n).tolist()))


def _fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = np.array([fingerprint(t) for t in encoded(part.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], names=["id", "fp"])


def _part(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _values(fp: Column) -> list[Column]:
    """The values of a fingerprint's segments, told apart by segment."""
    return [_part(fp, first, width) + F.lit(s << 22) for s, (first, width) in enumerate(SEGMENTS)]


def _keys(fp: Column) -> Column:
    """An array of (place, key, value, met) of a fingerprint: for each segment one with its value as key, and one for each of its bits as a wildcard.

    ``value`` is the segment's value and ``met`` the value that it is compared with; both are told apart by segment."""
    found = []
    for s, (first, width) in enumerate(SEGMENTS):
        value = _part(fp, first, width)
        named = lambda v, s=s: (v + F.lit(s << 22)).alias("x")
        found.append(F.struct(F.lit(64 + s).alias("place"), named(value).alias("key"), named(value).alias("value"), named(value).alias("met")))
        for bit in range(width):
            flipped = value.bitwiseXOR(F.lit(1 << bit))
            found.append(F.struct(F.lit(first + bit).alias("place"), named(F.least(value, flipped)).alias("key"), named(value).alias("value"), named(flipped).alias("met")))
    return F.array(*found)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as (node, root): every node but the roots once; nodes have one root if they are connected."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == was).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MOST_BITS


def _compared(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within the groups of sorted rows. Rows of a group with sides 0 and 1 are compared across; those with side -1 with all."""
    firsts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((firsts, [len(group)])))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero((size > 1) & (size < _LARGE))
    g, f, s = group[small], fp[small], side[small]
    for d in range(1, int(sizes[sizes < _LARGE].max(initial=1))):
        # rows of small groups against those d rows on
        at = np.flatnonzero((g[d:] == g[:-d]) & ((s[d:] < 0) | (s[d:] != s[:-d])))
        at = at[_within(f[at], f[at + d])]
        found.append((f[at], f[at + d]))
    for first, n in zip(firsts[sizes >= _LARGE].tolist(), sizes[sizes >= _LARGE].tolist(), strict=True):
        f, s = fp[first : first + n], side[first : first + n]
        x, y = (f, f) if s[0] < 0 else (f[s == 0], f[s == 1])
        edges = []
        for i in range(0, len(x), 512):
            p, q = np.nonzero(_within(x[i : i + 512, None], y[None, :]))
            edges.append(forest(x[i + p], y[q]))
        found.append(forest(*(np.concatenate([e[k] for e in edges]) for k in (0, 1))) if edges else (f[:0], f[:0]))
    return forest(*(np.concatenate([e[k] for e in found]) for k in (0, 1))) if found else (fp[:0], fp[:0])


def _linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of links, from rows (key, i, j, side, fp) sorted by key and blocks. A group is never cut; some batches are compared at once."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))) if rows.shape[1] else np.zeros(0, bool)
        a, b = _compared(np.cumsum(new), rows[3], rows[4].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for part in parts:
        held.append(np.array([part.column(c).to_numpy() for c in ("key", "i", "j", "side", "fp")], np.int64).reshape(5, -1))
        if sum(x.shape[1] for x in held) >= _RUN:
            rows = np.concatenate(held, axis=1)
            last = (rows[:3] != rows[:3, -1:]).any(axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # what belongs to the last group waits
            held = [rows[:, cut:]]
            if cut:
                yield done(np.ascontiguousarray(rows[:, :cut]))
    if held:
        yield done(np.ascontiguousarray(np.concatenate(held, axis=1)))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` of ``nodes`` within MOST_BITS bits of each other, over others where need be."""
    spark = nodes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = nodes.repartition(parts).select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.*")  # the nodes are few bytes, their keys many
    values = nodes.select(F.explode(F.array(*_values(F.col("fp")))).alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    values = saved(values.select("value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "simhash-values")
    hot = values.count()
    own = hinted(values.withColumnRenamed("blocks", "own"), hot, BROADCAST_VALUES)
    met = hinted(values.select(F.col("value").alias("met"), F.col("blocks").alias("others")), hot, BROADCAST_VALUES)
    # a row meets every block of the value that it is compared with
    dealt = keyed.join(own, "value", "left").join(met, "met", "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.coalesce("own", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("others", F.lit(1)) - 1)))
    alone, low = F.col("place") >= 64, F.col("value") == F.col("key")
    side = F.when(alone, -1).when(low, 0).otherwise(1)
    i = F.when(alone, F.least("block", "other")).when(low, F.col("block")).otherwise(F.col("other"))
    j = F.when(alone, F.greatest("block", "other")).when(low, F.col("other")).otherwise(F.col("block"))
    key = F.shiftleft(F.col("place").cast("long"), 32) + F.col("key")
    dealt = dealt.select(key.alias("key"), i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("long").alias("side"), "fp")
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return saved(dealt.mapInArrow(_linked, "a long, b long"), "simhash-links")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id under its own name, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Texts are linked where their fingerprints differ in at most four bits. Words are runs of characters other than ASCII white space, A-Z
    lower-cased; a text of fewer than four words is one shingle. A null text, or one without words, has fingerprint zero and is linked like any
    other. Repeated rows stay and are linked. A null id takes part, but never names a component while another id does. Ids are whole
    numbers. Other columns of ``docs``, whatever their names, are not looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        seen = saved(rows.mapInArrow(_fingerprints, "id long, fp long"), "simhash-seen")
    nodes = saved(seen.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    named = nodes.join(components(links(nodes), "simhash").withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = saved(named, "simhash-named")
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    found = saved(named.select("fp", "component").join(smallest, "component").select("fp", "first"), "simhash-components")
    out = seen.join(found, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))
