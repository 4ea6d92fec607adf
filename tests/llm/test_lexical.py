"""Ranked search against SQL (test_llm_sql.py), brute force and odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from test_llm_operators import clashing, docs

from postsieve.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, items, top=10):
    """(item id, rank, doc id, score) with nulls last."""
    counts = [Counter(terms(t)) for _, t in rows]
    n = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for (doc_id, _), c, size in zip(rows, counts, n, strict=True):
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 10 + 90 * size * n_docs // n_terms
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort(key=lambda x: x[:3])
        out += [(item_id, k + 1, doc_id, -less) for k, (less, _, _, doc_id) in enumerate(found[:top])]
    return sorted(out, key=str)


def searched(df, items):
    return sorted((tuple(r) for r in lexical.ranked_search(df, items).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("block", "bundle", "owners"), [(8192, 256, 4), (16, 3, 4), (40, 2, 7), (16, 256, 1)])
def test_search_of_any_blocks_bundles_and_owners(spark, monkeypatch, block, bundle, owners):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(25)]  # ties over the end of a result
    items = [(i, text(rng.randrange(1, 15))) for i in range(12)] + [(50, rows[7][1])]
    for name, value in (("BLOCK_DOCS", block), ("BUNDLE_ITEMS", bundle), ("OWNERS", owners)):
        monkeypatch.setattr(lexical, name, value)
    assert searched(docs(spark, *rows), item_table(spark, items)) == brute(rows, items)


def test_accumulators_are_pruned(spark, monkeypatch):
    """Once ten documents hold all rare terms of an item, those that hold common ones only are carried no further."""
    rows = [(i, "rare1 rare2 rare3 common") for i in range(12)] + [(100 + i, f"common other{i % 7}") for i in range(400)]
    kept = []
    real = lexical.saved
    monkeypatch.setattr(lexical, "saved", lambda df, what: kept.append((what, real(df, what))) or kept[-1][1])
    items = [(1, "rare1 rare2 rare3 common")]
    assert searched(docs(spark, *rows), item_table(spark, items)) == brute(rows, items)
    last = [df for what, df in kept if what == "lexical-bundles"][-1]
    assert sum(len(r.acc_row) for r in last.collect()) == 12


def test_terms(spark):
    text = "Ab_c-D1 é ü\x7fx\x00y ÄÖ 中文,z\U0001f600q"
    assert list(lexical.term_counts(text.encode())) == [t.encode() for t in dict.fromkeys(terms(text))]
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(lexical.terms_of(df.t)).collect()] == [list(dict.fromkeys(terms(text))), [], []]


def test_search_of_odd_rows(spark):
    long = "alpha beta " * 30_000
    rows = [(1, "Alpha beta"), (1, "Alpha beta"), (None, "alpha BETA"), (2, None), (3, ""), (4, "--- ..."), (5, long), (6, "gamma"), (None, None), (7, "x" * 300_000)]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (4, "unseen words"), (5, "beta gamma"), (5, "gamma"), (None, "beta"), (6, "x" * 300_000)]
    df = docs(spark, *rows)
    assert searched(df, item_table(spark, items)) == brute(rows, items)
    assert searched(clashing(df), clashing(item_table(spark, items))) == brute(rows, items)
    for d, i in ((df.limit(0), item_table(spark, items)), (df, item_table(spark, items).limit(0)), (df.limit(0), item_table(spark, items).limit(0))):
        assert lexical.ranked_search(d, i).count() == 0
