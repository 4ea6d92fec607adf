"""Spelling variants against brute force and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import clashing, docs

from postsieve.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 2}


def brute_near(words):
    """Near words by deletions: words with one letter deleted, at one place, are equal or equal to the other word."""
    by_gap, near = {}, {w: set() for w in words}
    long = [w for w in words if len(w) > 500]
    for a in long:
        for b in long:
            k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
            if a != b and b[k + (len(b) >= len(a)) :] == a[k + (len(a) >= len(b)) :]:
                near[a].add(b)
    for w in (w for w in words if len(w) <= 500):
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in near:
                near[w].add(short)
                near[short].add(w)
            by_gap.setdefault((k, short), []).append(w)
    for same in by_gap.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    return near


def brute(rows):
    n = brute_words(rows)
    near = brute_near(n)
    forms = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                forms[w] = best
    out = {}
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n[w], len(near[w]), n[forms[w]] if w in forms else None)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_variants_match_brute_force(spark, size):
    sf = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_spelling(spark, sf)) == brute(rows)


def made_words(rng, letters="abcdé", sizes=(7, 12)):
    words = set()
    while len(words) < 300:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(*sizes)))
        words.add(w)
        for _ in range(3):
            k, c = rng.randrange(len(w) + 1), rng.choice(letters)
            words.add(rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]))
    return [w for w in words if len(w) >= 7]


@pytest.mark.parametrize(("sample", "leaf", "block"), [(65_536, 2048, 8192), (64, 16, 8192), (200, 8, 20), (0, 8, 50)])
def test_near_words_of_any_trees_and_blocks(spark, monkeypatch, sample, leaf, block):
    """Words of few letters, so leaves are crowded; trees from small samples, or none, find the same pairs, each once."""
    words = [*made_words(random.Random(5)), "a" * 200, "a" * 201, "b" + "a" * 199, "abcdefg" * 3000, "abcdefg" * 2999 + "abcdef"]
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    monkeypatch.setattr(spelling, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(spelling, "BLOCK_QUERIES", 2 * block)
    n = {w: i + 2 for i, w in enumerate(words)}
    pairs = [tuple(r) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(w, x, n[x]) for w, near in brute_near(words).items() for x in near}


def random_letters(rng, n, size):
    alphabet = [*range(97, 123), *range(192, 256)]
    return spelling.Letters([bytes(rng.choice(alphabet, size).astype(np.uint8)) for _ in range(n)])


def test_tree_prunes_and_loses_nothing():
    words = random_letters(np.random.default_rng(2), 4000, 36)
    counts = words.counts()
    assert all((words.count(a) == counts[:, a]).all() for a in range(90))
    tree = spelling.Tree(counts, 16)
    leaf_of = np.full(len(counts), -1)
    for leaf, rows in tree.visit(words, 0, 0):
        assert (leaf_of[rows] < 0).all()
        leaf_of[rows] = leaf
    assert (leaf_of >= 0).all() and tree.leaves > 200
    asked, visits = counts[:100].copy(), {}
    for leaf, rows in tree.visit(words, 1, 1):
        for r in rows.tolist():
            visits.setdefault(r, set()).add(leaf)
    for r in range(100):
        up, down = np.maximum(counts - asked[r], 0).sum(axis=1), np.maximum(asked[r] - counts, 0).sum(axis=1)
        assert set(leaf_of[(up <= 1) & (down <= 1)].tolist()) <= visits[r]
        assert len(visits[r]) < tree.leaves / 2


def test_equal_vectors_make_one_leaf():
    same = np.tile(np.arange(90, dtype=np.int32), (50, 1))
    assert spelling.Tree(same, 4).leaves == 1
    far = np.zeros((20, 90), np.int32)
    far[:, 3] = 1000 + np.arange(20)
    assert spelling.Tree(far, 4).leaves > 1


def test_signatures_never_exceed_the_distance():
    rng = np.random.default_rng(4)
    for size in (7, 30, 200):
        a, b = (random_letters(rng, 500, size) for _ in range(2))
        assert (np.bitwise_count(a.signatures() ^ b.signatures()) <= np.abs(a.counts() - b.counts()).sum(axis=1)).all()
        assert (np.bitwise_count(a.signatures() ^ random_letters(rng, 500, size + 1).signatures()) > 0).any()


def test_roots_follow_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [(f"x{i}", "w0") for i in range(50)]
    ends = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert ends == {w: "w21" for w, _ in forms}


def test_ties_and_the_tenfold_rule(spark):
    text = " ".join(["abcdefgh"] * 30 + ["abcdefgi"] * 30 + ["abcdefgx"] * 3 + ["abcdefgzz"] * 2 + ["abcdefgz"] * 4)
    n = brute_words([(1, text)])
    out = found(spelling.spelling_variants(docs(spark, (1, text))))
    assert out == brute([(1, text)])
    assert out["abcdefgx"][:2] == ("abcdefgh", "abcdefgh") and n["abcdefgx"] == 3
    assert out["abcdefgz"][0] is None and out["abcdefgh"][0] is None


def test_variants_of_odd_rows(spark):
    long = "Überfluß " * 20_000 + "ÀÿÀÿÀÿÀ " * 3 + "x" * 300_000
    rows = [(1, "Running running RUNNING runnings"), (1, "Running running RUNNING runnings"), (2, None), (None, "running runnings"), (3, ""), (4, " 123 ab_c\n"), (5, long), (6, "x" * 300_000), (None, None)]
    df = docs(spark, *rows)
    out = found(spelling.spelling_variants(clashing(df)))
    assert out == brute(rows)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(docs(spark, (1, "short words only here"))).count() == 0
