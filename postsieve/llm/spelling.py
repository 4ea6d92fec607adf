"""Spelling variants: words one edit apart, found with k-d trees over letter-count vectors, and the common form that each points to.

1. Words are counted over all texts.
2. An edit changes few letter counts: a replaced letter makes one count smaller and one larger (L1 distance two), an inserted one makes one count larger
   (L1 distance one). So near words are searched for each pair of lengths, L with L and L - 1 with L, as a range search among the words of length L.
3. For each length a k-d tree of letter counts is fitted on a bounded sample of the words; every word has one place in it, and is sent as a query to all
   leaves whose box a near word could lie in. A leaf is searched in a task, by a tree of its own; crowded leaves are dealt out in blocks.
4. Hits within the distance are verified letter by letter. Each word keeps the number of near words and the most frequent one.
5. Forms are followed to their end by doubling: a form is ten times as frequent as its word, so chains are short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, saved

#: Fewest letters and occurrences of a word, how many times as frequent its form is, and one word in how many has a letter deleted.
LEAST_LETTERS, LEAST_N, TIMES, DELETED = 7, 2, 10, 31
LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words on which trees are fitted (about), the longest of them, and the number of a length's words that a leaf is to hold.
SAMPLE, LONGEST, LEAF_WORDS = 65_536, 64, 4096
#: Members and queries from which a leaf is dealt out in blocks of that size, and the words of a leaf of the tree within a task.
BLOCK_MEMBERS, BLOCK_QUERIES, INNER_WORDS = 8192, 100_000, 256
#: Rows of leaf sizes that may be broadcast; there are at most some ten thousand leaves, and one for each length.
BROADCAST_LEAVES = 200_000
#: Queries that are searched at a time, and those of a leaf that are compared at a time.
_QUERIES, _ROWS = 8192, 512
_MOST_COUNT = 1 << 30
MEMBER, SAME, SHORTER = 0, 1, 2

_DIMS = 26 + 64
_DIM = np.full(256, -1, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[192:256] = 26 + np.arange(64)
_CODE = np.concatenate([np.arange(97, 123), np.arange(192, 256)]).astype(np.uint8)
#: The bit of a letter's group: a-z have one each, the others share six.
_GROUP_BIT = np.left_shift(np.uint64(1), np.where(_DIM < 26, _DIM, 26 + _DIM % 6).clip(0).astype(np.uint64))


def words_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the words of all texts and their occurrences.

    A word is a maximal run of letters, A-Z lower-cased; where the CRC-32 h of "id:run" is divisible by DELETED it has lost its letter at h modulo its length.
    """
    # a run that is too short to begin with can't be long enough after a deletion
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}+"), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.translate("run", _UPPER, _LOWER))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % DELETED == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_N)


class Letters:
    """Words of one length: their letters as rows of codes, and counts of single letters as they are asked for."""

    def __init__(self, words: list[bytes]):
        self.rows = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        self.places = np.ascontiguousarray(self.rows.T)  # all first letters, all second ones, ...
        self._counts: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.rows)

    def count(self, axis: int) -> np.ndarray:
        """How often each word has a letter."""
        if axis not in self._counts:
            self._counts[axis] = (self.places == _CODE[axis]).sum(axis=0, dtype=np.int32)
        return self._counts[axis]

    def counts(self) -> np.ndarray:
        """The whole letter-count vectors."""
        place = np.arange(len(self))[:, None] * _DIMS + _DIM[self.rows]
        return np.bincount(place.ravel(), minlength=len(self) * _DIMS).reshape(-1, _DIMS).astype(np.int32)

    def signatures(self) -> np.ndarray:
        """64 bits of each word: two for each of 32 groups of letters, for one and for two or more. Vectors differ by at least as much as these bits do."""
        once, twice = np.zeros(len(self), np.uint64), np.zeros(len(self), np.uint64)
        for place in self.places:
            bit = _GROUP_BIT[place]
            twice |= once & bit
            once |= bit
        return once | twice << np.uint64(32)


class Tree:
    """A k-d tree of letter counts. A node has an axis and a cut: counts up to the cut are left of it."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # axis, cut, left, right; of a leaf -1, its number, 0, 0
        self.leaves = 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(counts)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[2 + side] = here
                self.nodes[parent] = tuple(node)
            axis, cut = self._split(counts[rows]) if len(rows) > capacity else (-1, 0)
            if axis < 0:
                self.nodes.append((-1, self.leaves, 0, 0))
                self.leaves += 1
                continue
            self.nodes.append((axis, cut, 0, 0))
            low = counts[rows, axis] <= cut
            todo += [(rows[~low], here, 1), (rows[low], here, 0)]

    @staticmethod
    def _split(counts: np.ndarray) -> tuple[int, int]:
        """The axis and cut that come nearest to halves, or axis -1 where all vectors are equal."""
        best, found, varied = 0, (-1, 0), np.flatnonzero(counts.min(axis=0) != counts.max(axis=0))
        for axis in varied.tolist():
            below = np.cumsum(np.bincount(np.minimum(counts[:, axis], 256)))
            even = np.minimum(below, len(counts) - below)
            if even.max() > best:
                best, found = int(even.max()), (axis, int(even.argmax()))
        if not best and len(varied):  # they differ in very large counts only
            axis = int(varied[0])
            found = (axis, int((int(counts[:, axis].min()) + int(counts[:, axis].max())) // 2))
        return found

    def visit(self, words: Letters, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``words``) for the leaves whose box holds a vector with at most ``more`` letters more and ``fewer`` letters fewer than the row."""
        none = np.zeros(len(words), np.int32)
        todo = [(0, np.arange(len(words)), none, none, {})]
        while todo:
            at, rows, up, down, box = todo.pop()
            if not len(rows):
                continue
            axis, cut, left, right = self.nodes[at]
            if axis < 0:
                yield cut, rows
                continue
            low, high = box.get(axis, (0, _MOST_COUNT))
            own = words.count(axis)[rows]
            # what the box asks of this axis takes the place of what it asked before
            new_up = up + np.maximum(cut + 1 - own, 0) - np.maximum(low - own, 0)
            new_down = down + np.maximum(own - cut, 0) - np.maximum(own - high, 0)
            right_in, left_in = new_up <= more, new_down <= fewer
            todo.append((right, rows[right_in], new_up[right_in], down[right_in], box | {axis: (cut + 1, high)}))
            todo.append((left, rows[left_in], up[left_in], new_down[left_in], box | {axis: (low, cut)}))


def fit(vocabulary: DataFrame) -> dict[int, Tree]:
    """A tree for each length, fitted on about SAMPLE words, those with small hashes; longer words than LONGEST have one leaf for each length."""
    n = vocabulary.count()
    least = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    short = vocabulary.where((F.length("word") <= LONGEST) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < least)).select("word")
    sample = [r.word.encode("latin-1") for r in short.collect()]
    capacity = max(8, LEAF_WORDS * len(sample) // max(n, 1))
    by_length: dict[int, list[bytes]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    return {size: Tree(Letters(found).counts(), capacity) for size, found in by_length.items()}


_ONE_LEAF = Tree(np.zeros((0, _DIMS), np.int32), 1)
_ROUTED = "size int, leaf int, role int, word string, n long"


def _routed(trees: dict[int, Tree]):
    """Each word as a member of its leaf and as a query of the leaves where near words of its length, or of one letter more, can be."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            by_length: dict[int, list[int]] = {}
            words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
            for i, w in enumerate(words):
                by_length.setdefault(len(w), []).append(i)
            for size, rows in by_length.items():
                own, rows = Letters([words[i] for i in rows]), np.array(rows)
                for role, longer, more, fewer in ((MEMBER, 0, 0, 0), (SAME, 0, 1, 1), (SHORTER, 1, 1, 0)):
                    for leaf, at in trees.get(size + longer, _ONE_LEAF).visit(own, more, fewer):
                        taken = pa.array(rows[at])
                        same = [pa.array(np.full(len(at), x, np.int32)) for x in (size + longer, leaf, role)]
                        yield pa.RecordBatch.from_arrays([*same, part.column("word").take(taken), part.column("n").take(taken)], names=["size", "leaf", "role", "word", "n"])

    return run


class Members:
    """Words of one length that queries are compared with."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.words, self.n, self.letters = words, n, Letters(words)
        self.tree, self.bits = Tree(self.letters.counts(), INNER_WORDS), self.letters.signatures()
        self.inside = dict(self.tree.visit(self.letters, 0, 0))

    def near(self, asked: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, member) for each pair one edit apart. The rows have the members' length, or one letter less."""
        less = self.letters.rows.shape[1] - asked.rows.shape[1]
        bits, found = asked.signatures(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for leaf, rows in self.tree.visit(asked, 1, 1 - less):
            inside = self.inside.get(leaf)
            if inside is None:
                continue
            theirs = self.bits[inside][None, :]
            for k in range(0, len(rows), _ROWS):
                some = rows[k : k + _ROWS]
                i, j = np.nonzero(np.bitwise_count(bits[some, None] ^ theirs) <= 2 - less)
                found.append((some[i], inside[j]))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        some = max(1, 5_000_000 // max(1, asked.rows.shape[1]))
        good = np.concatenate([np.zeros(0, bool), *[self._one_edit(asked.rows[i[k : k + some]], self.letters.rows[j[k : k + some]]) for k in range(0, len(i), some)]])
        return i[good], j[good]

    @staticmethod
    def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows of letters differ by one replaced letter, or by one that b has more."""
        if a.shape[1] == b.shape[1]:
            return (a != b).sum(axis=1) == 1
        before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
        after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        return before + after >= a.shape[1]


_NEAR = "word string, near string, near_n long"


def _searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (word, near word) from rows sorted by leaf and blocks, in which members come before queries."""
    now, members, searched = None, [], None
    for part in parts:
        keys = np.stack([part.column(c).to_numpy() for c in ("size", "leaf", "queries", "members", "role")])
        words, n = [w.encode("latin-1") for w in part.column("word").to_pylist()], part.column("n").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))).tolist() if len(words) else []
        for first, last in zip(cuts, [*cuts[1:], len(words)], strict=True):
            group, role = tuple(keys[:4, first].tolist()), int(keys[4, first])
            if group != now:
                now, members, searched = group, [], None
            if role == MEMBER:
                members.append((words[first:last], n[first:last]))
                continue
            if not members:
                continue
            searched = searched or Members([w for m in members for w in m[0]], np.concatenate([m[1] for m in members]))
            for k in range(first, last, _QUERIES):
                asked = words[k : min(last, k + _QUERIES)]
                i, j = searched.near(Letters(asked))
                ours, theirs = [asked[x].decode("latin-1") for x in i.tolist()], [searched.words[x].decode("latin-1") for x in j.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ours, pa.string()), pa.array(theirs, pa.string()), pa.array(searched.n[j], pa.int64())], names=["word", "near", "near_n"])
                if role == SHORTER:  # words of the same length ask for themselves
                    yield pa.RecordBatch.from_arrays([pa.array(theirs, pa.string()), pa.array(ours, pa.string()), pa.array(n[k + i], pa.int64())], names=["word", "near", "near_n"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) for all words of ``vocabulary`` (word, n) that are one inserted, deleted or replaced letter apart, in both directions."""
    spark = vocabulary.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = saved(vocabulary.repartition(parts).mapInArrow(_routed(fit(vocabulary)), _ROUTED), "spelling-routed")
    asks = F.col("role") > MEMBER
    sizes = routed.groupBy("size", "leaf").agg(F.ceil(F.count_if(~asks) / BLOCK_MEMBERS).cast("int").alias("m"), F.ceil(F.count_if(asks) / BLOCK_QUERIES).cast("int").alias("q"))
    sizes = saved(sizes.where("m > 0 and q > 0"), "spelling-sizes")
    dealt = routed.join(hinted(sizes, sizes.count(), BROADCAST_LEAVES), ["size", "leaf"])  # leaves without members, or without queries, go
    own = F.pmod(F.xxhash64("word"), F.when(asks, F.col("q")).otherwise(F.col("m"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(asks, F.col("m")).otherwise(F.col("q")) - 1)))
    queries, members = F.when(asks, F.col("own")).otherwise(F.col("other")), F.when(asks, F.col("other")).otherwise(F.col("own"))
    dealt = dealt.select("size", "leaf", queries.alias("queries"), members.alias("members"), "role", "word", "n")
    keys = ["size", "leaf", "queries", "members"]
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "role").mapInArrow(_searched, _NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from ``forms`` (word, form): the end of the chain of forms. Chains must not be circles."""
    reached = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = saved(step, "spelling-roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        reached = step.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the texts of ``docs`` that has enough letters and occurrences.

    n_near: its near words. form: the most frequent of them, the first in code-point order among equals, if it is ten times as frequent as the
    word; form_n: its occurrences. root: what following forms leads to, or the word itself. A null or empty text has no words. A null id reads as an
    empty text. Repeated rows count as often as they are there. Other columns are not looked at. An empty table gives no rows.
    """
    vocabulary = saved(words_of(docs, id_col, text_col), "spelling-words")
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    rows = vocabulary.join(near, "word", "left")
    common: Column = -F.col("best.less") >= TIMES * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    rows = saved(rows, "spelling-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
