"""Training-data operators against brute force, round trips and edge cases."""

import datetime
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postsieve.llm import chat, components, decontam, licenses, lmscore, mix, ngramjoin, pii, quality, queries, shards, urlfilter, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 60_000


def docs(spark, *rows):
    """Documents from (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)


def odd_rows(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, an id with two texts."""
    return docs(
        spark, (1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, None, None, None), (None, "a b c d e f g", "en", None), (3, "", "en", "s"), (4, " \n\t ", None, "s"),
        (5, LONG, "en", "s"), (6, "x" * 300_000, "en", "t"), (7, "a b c d e f g h", "en", "t"), (7, "another text altogether, of seven words here", "en", "t"), (None, None, None, None),
    )


def clashing(df):
    """The same rows with columns named like those that operators make and use."""
    names = "size source_size target slot vslot shard stats kept grp distance base_failed host path rule verdict listed pii id node cluster band license origin home mix_size mix_copies mix_shards block_ url_ text_ row_ target_id"
    return df.withColumns({n: F.lit("mine") for n in names.split() if n not in df.columns})


def shingle_set(text, k=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


# words


def test_word_hashes_follow_the_words():
    texts = ["a b  c", "", "ü\u00a0x y", "a\x0bb\x0cc\rd\ne\tf", " lead", "b a"]
    hashes, bounds = words.word_hashes([t.encode() for t in texts])
    known = {}
    for n, t in enumerate(texts):
        own = hashes[bounds[n] : bounds[n + 1]]
        found = WORD.findall(t)
        assert len(own) == len(found)
        for h, w in zip(own, found, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_shingles_of_short_texts():
    hashes, _ = words.word_hashes([b"a b c"])
    assert len(words.shingles(hashes, 5)) == 1 and len(words.shingles(hashes, 2)) == 2 and len(words.shingles(hashes[:0], 5)) == 0
    assert words.shingles(hashes, 3)[0] == words.shingles(hashes, 5)[0]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(n, n + 1) for n in range(0, 40)] + [(100, n) for n in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame([*pairs, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {n: find(n) for n in root}
    assert components.components(df.limit(0)).count() == 0


# 9: n-gram Jaccard join


def test_minhash_estimates():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        err = []
        for _ in range(20):
            a = rng.integers(0, 2**63, 400).astype(np.uint64)
            both = int(2 * 400 * share / (1 + share))
            b = np.concatenate([a[:both], rng.integers(0, 2**63, 400 - both).astype(np.uint64)])
            err.append((ngramjoin.signature(a) == ngramjoin.signature(b)).mean() - both / (800 - both))
        assert abs(np.mean(err)) < 0.02


def test_needed_matches_keep_pairs_at_the_threshold():
    need = ngramjoin.needed()
    for n, m in zip(range(ngramjoin.STEP, ngramjoin.HASHES + 1, ngramjoin.STEP), need, strict=True):
        lost = sum(math.comb(n, j) * 0.8**j * 0.2 ** (n - j) for j in range(m))
        assert lost < 1e-4 and 0 < m < n


def test_join_of_odd_rows(spark):
    rows = ngramjoin.ngram_jaccard_join(clashing(odd_rows(spark))).collect()
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in rows), key=str)
    # the text of 1 (three times, once without an id) has 3 shingles, that of 7 has 4 with 3 shared: 0.75
    want = [(1, 1, 2, 3), (1, 1, 2, 3), (None, 1, 2, 3), (2, 2, 0, 0), (3, 3, 0, 0), (4, 4, 0, 0), (5, 5, 0, 1), (6, 6, 0, 1), (7, 7, 0, 4), (7, 7, 0, 3), (None, None, 0, 0)]
    assert got == sorted(want, key=str)
    assert ngramjoin.ngram_jaccard_join(odd_rows(spark).limit(0)).count() == 0


def test_rows_with_one_id_or_none_are_not_multiplied(spark):
    """Each candidate meets the text of its own row only, however many rows share its id."""
    texts = near_copies(30) + [f"alone{i} b c d e f g" for i in range(270)]
    rows = ngramjoin._rows(docs(spark, *[(None, t) for t in texts]), "doc_id", "text")
    nodes = rows.select(F.col("text").cast("binary").alias("node"), "id", "crc")
    met = ngramjoin._fetched(rows, nodes)
    assert met.count() == met.select("node", "text").distinct().count() == len(set(texts))
    joined = ngramjoin.ngram_jaccard_join(docs(spark, *[(7, t) for t in texts]))
    assert joined.count() == 300 and {r.class_id for r in joined.select("class_id").distinct().collect()} == {7}


def test_one_of_each_class_loses_no_text(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, "A"), (2, "A"), (2, "B"), (3, "C"), (3, "D"), (None, "E"), (None, "E"), (None, "A"), (9, "E"), (5, ""), (5, ""), (6, None)]
    frame = docs(spark, *[(i, text(c) if c else c, "en", "s") for i, c in rows])
    for width in (0, ngramjoin.BROADCAST_IDS):
        ngramjoin_ids, ngramjoin.BROADCAST_IDS = ngramjoin.BROADCAST_IDS, width
        try:
            got = Counter((r.doc_id, r.text) for r in ngramjoin.one_of_each_class(clashing(frame)).collect())
        finally:
            ngramjoin.BROADCAST_IDS = ngramjoin_ids
        assert got == Counter({(1, text("A")): 1, (2, text("B")): 1, (3, text("C")): 1, (3, text("D")): 1, (9, text("E")): 1, (5, ""): 2, (6, None): 1})
    assert ngramjoin.one_of_each_class(frame).columns == frame.columns
    assert ngramjoin.one_of_each_class(frame.limit(0)).count() == 0


def near_copies(n, seed=5, length=120, edits=2):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_join_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_TEXTS", 16)
    texts = near_copies(70) + near_copies(9, seed=6) + ["alone " + str(i) + " b c d e f" for i in range(5)]
    sets = [shingle_set(t) for t in texts]
    links = {i: [j for j in range(len(sets)) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(sets))}
    seen = {}
    for i in range(len(sets)):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = seen[i] if x != i else i
                stack += links[x]
    rows = ngramjoin.ngram_jaccard_join(docs(spark, *enumerate(texts))).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (seen[i], len(links[i])) for i in range(len(sets))}


def test_both_ways_to_count_shared_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(40)]
    i, j = (x.ravel() for x in np.indices((40, 40)))
    want = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (ngramjoin._common(sets, sets, i, j) == want).all()
    assert (ngramjoin._common(sets, sets, i[:3], j[:3]) == want[:3]).all()


# 1: mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = min(share, most) * sum(sizes.values())
    target, free = {}, set(names)
    while free:
        left = total - sum(target.values())
        own = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if own[s] > most * sizes[s]}
        if not over:
            return target | own
        target |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return target


def test_targets_match_reshared_excess(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {f"s{n}": rng.choice([0, 1, 10, 100, 5000]) + rng.randrange(9) for n in range(rng.randrange(1, 12))} | ({None: 50} if seed % 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mix.source_targets(df, (5, 2, 1), 1.5, 2).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix_comes_near_its_targets(spark):
    rows = queries.op1_mix(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source", "text"), "doc_id").toPandas()
    assert len(rows) == 1000 and (rows["size"] == [len(WORD.findall(t)) for t in rows.text]).all()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken % rows["size"].clip(lower=1) == 0).all()
    sizes = rows.groupby("source")["size"].sum().to_dict()
    want = brute_targets(sizes)
    for source, part in rows.groupby("source"):
        assert (part.source_size == sizes[source]).all() and part.target.iloc[0] == pytest.approx(want[source])
        assert part.taken.sum() == pytest.approx(want[source], rel=0.01)
    again = queries.op1_mix(spark, "/root/testdata/sf0.01").toPandas()
    assert again.drop(columns="mix_shards").sort_values("doc_id").values.tolist() == rows[again.columns.drop("mix_shards")].sort_values("doc_id").values.tolist()
    copies = rows.mix_shards.map(len)
    assert (copies * rows["size"] == rows.taken).all() and rows.mix_shards.map(lambda s: all(0 <= x < 8 for x in s)).all()
    assert len({x for s in rows.mix_shards for x in s}) == 8


def test_splitting_tree_is_exact():
    quotas = [0, 1, 7, 500, 64]
    out = mix.split_quotas(quotas, 7, 3)
    assert out.sum(0).tolist() == quotas and out.min() >= 0 and out.sum(1).max() - out.sum(1).min() <= 2
    assert (out == mix.split_quotas(quotas, 7, 3)).all()


def test_mix_of_odd_rows(spark):
    rows = clashing(odd_rows(spark))
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    out = mix.mix_sources(rows, size)
    assert out.count() == 11 and set(out.columns) == set(rows.columns) | {"mix_size", "source_size", "source_target", "mix_copies", "mix_shards"}
    assert out.where("text is null").agg(F.max("mix_size")).first()[0] == 0
    mixed = mix.mixed_rows(out, ["doc_id", "text"])
    assert mixed.count() == out.agg(F.sum("mix_copies")).first()[0]
    assert mix.mix_sources(rows.limit(0), size).count() == 0


def test_mix_never_reads_a_row_more_often_than_most(spark):
    """A source of 399 texts without words and one of 40 words; its target is the limit of twice its words."""
    rows = docs(spark, *[(n, None, "en", "a") for n in range(399)], (399, "w " * 40, "en", "a"), (400, "v " * 4000, "en", "b"))
    out = mix.mix_sources(rows, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    got = out.groupBy("source").agg(F.max("mix_copies").alias("most"), F.sum(F.col("mix_copies") * F.col("mix_size")).alias("words"), F.max("source_target").alias("target"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"a": 400, "b": 1} and all(r.most <= 2 for r in got)
    assert {r.source: r.words for r in got}["a"] == 80 == {r.source: r.target for r in got}["a"]


def test_mix_of_one_row_many_times(spark):
    """A third of a source is one row; its readings still meet the target, and rows that are equal are written as often as they are read."""
    rows = docs(spark, *[(7, "w " * 9, "en", "a")] * 300, *[(n, "v " * (n % 30 + 1), "en", "a") for n in range(1000, 1600)], *[(n, "u " * 20, "en", "b") for n in range(2000, 2900)])
    for width in (mix.BROADCAST_ROWS, 0):
        was, mix.BROADCAST_ROWS = mix.BROADCAST_ROWS, width
        try:
            out = mix.mix_sources(rows, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cache()
            assert out.count() == 1800
            for r in out.groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.max("source_target").alias("target"), F.max("mix_copies").alias("most")).collect():
                assert r.most <= 2 and abs(r.taken - r.target) <= 10
        finally:
            mix.BROADCAST_ROWS = was
        out.unpersist()


def test_no_text_is_in_a_window_of_the_mix(spark):
    out = mix.mix_sources(docs(spark, *[(n, "w " * n, "en", "a") for n in range(1, 200)]), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "row_" in plan and "Window" not in plan  # the windows are in the tables of groups and blocks


# 2: chat


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "[\\INST][INST]", "<s", "</s", "é\u2028[/INST]\n", "", "<s><s></s>", "[[INST]]", "<</s>>"])
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL.values())


def test_assemble():
    ids, mask = chat.assemble([([1], False), ([2, 3], True), ([], True), ([4], False), ([5], True)])
    assert ids.tolist() == [1, 2, 3, 4, 5] and mask.tolist() == [0, 1, 1, 0, 1]


def test_chat_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s> yes"), (1, 1, "assistant", "</s> yes"), (1, None, None, None), (None, 0, "assistant", "x"), (None, 1, "user", "y" * 50_000), (2, 0, "tool [INST]", ""),
        (3, 2, "assistant", LONG),
    ]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("id").withColumns({"ids": F.lit(1), "place": F.lit(1)})
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in (1, None, 2, 3):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[conv].formatted_chars == 3 + sum(17 + len(chat.escape(r)) + len(chat.escape(x)) for _, r, x in turns)
    spans = chat.format_turns(df).where("conv_id = 1").orderBy("place").collect()
    assert [s.start for s in spans] == np.cumsum([0] + [len(s.ids) for s in spans])[:-1].tolist()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# 3: decontamination


def test_containment(spark):
    item = " ".join(f"i{n}" for n in range(60))
    half = " ".join(f"i{n}" for n in range(30))
    noise = " ".join(f"n{n}" for n in range(20_000))
    rows = docs(
        spark, (1, f"{noise} {item} {noise}"), (2, f"x {half} y {noise} {' '.join(f'i{n}' for n in range(26, 60))}"), (3, half), (4, None), (5, ""), (6, "so it goes"), (7, "and so it goes on"), (None, item), (1, item), (8, LONG),
    )
    items = spark.createDataFrame([(1, item), (2, "so it goes"), (3, None), (4, ""), (1, item), (5, "word word")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.contained_items(clashing(rows), items).collect()), key=str)
    # the second document has the item in two pieces: 26 and 30 of its 56 shingles, and none that spans both is lost
    want = [(1, 1, 56, 56), (1, 1, 56, 56), (2, 1, 56, 56), (None, 1, 56, 56), (6, 2, 1, 1), (7, 2, 1, 1), (8, 5, 1, 1)]
    assert got == sorted(want, key=str)
    left = decontam.without_items(clashing(rows), items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5] and len(left.columns) == len(clashing(rows).columns)
    assert decontam.contained_items(rows.limit(0), items).count() == 0 and decontam.contained_items(rows, items.limit(0)).count() == 0
    assert decontam.without_items(rows, items.limit(0)).count() == rows.count()


def test_least_hits():
    h = decontam.least_hits(0.8)
    assert sum(math.comb(32, i) * 0.8**i * 0.2 ** (32 - i) for i in range(h)) <= 1e-9 and 5 < h < 20


def test_many_items_in_one_scan(spark, monkeypatch):
    """A filter too small to tell the probes apart, and joins by shuffles, find the same; item ids may be texts."""
    items = spark.createDataFrame([(f"item {n}", " ".join(f"q{n}w{i}" for i in range(12 if n % 2 else 70))) for n in range(60)], "item_id string, text string")
    rows = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    scans = []
    for power, width in ((28, 200_000), (10, 0)):
        monkeypatch.setattr(decontam, "MOST_FILTER", power)
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", width)
        found = decontam.contained_items(rows, items)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted((f"item {n}",) * 2 for n in range(60))
        assert decontam.without_items(rows, items).count() == 0
        scans.append(found._jdf.queryExecution().analyzed().toString().count("MapInArrow"))
    assert scans == [1, 1]


def test_many_items_of_one_text(spark, monkeypatch):
    """Items that share a text are searched for once, and each of them is found."""
    one, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(9))
    items = spark.createDataFrame([(n, one) for n in range(500)] + [(900, other), (901, None), (None, other)], "item_id long, text string")
    rows = docs(spark, *[(n, f"{n} {one} x{n}") for n in range(20)], (77, f"{other} {one}"))
    tables = []
    real = decontam.saved
    monkeypatch.setattr(decontam, "saved", lambda df, what: tables.append((what, real(df, what))) or tables[-1][1])
    found = {(r.doc_id, r.item_id) for r in decontam.contained_items(rows, items).collect()}
    assert found == {(n, i) for n in [*range(20), 77] for i in range(500)} | {(77, 900), (77, None)}
    assert max(len(r.items_) for what, df in tables if what == "decontam-candidates" for r in df.collect()) == 2


# 4: URLs


def test_urls(spark):
    rows = [
        (1, "http://A.Example.com/de/x?y#z"), (2, "http://badexample.com/de/x"), (3, "https://example.net/en/"), (4, "http://net/"), (5, "http://net"), (6, "no scheme"), (7, None), (8, ""), (9, "x://a.b.net/en/"),
        (10, "http://www.q.org/p/?b=2&utm_source=x&a=1"), (11, "http://q.org/p?a=1&b=2#top"), (12, "http://q.org/p?a=1&b=3"), (13, "http://q.org:80/fr/"), (14, "http://" + "a." * 3000 + "net/"), (4, "http://net/"),
    ]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    listed = df.where("page_id = 10").select("url")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df, rules, listed).collect()}
    assert got[1] == ("a.example.com", "/de/x", "example.com/de/", "block") and got[2] == ("badexample.com", "/de/x", None, "allow")
    assert got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("net/", "block") and got[5] == ("net", "", None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[9][2:] == ("net/", "block") and got[14][2] == "net/"
    assert got[10][3] == got[11][3] == "block" and got[12][3] == "allow" and got[13] == ("q.org:80", "/fr/", None, "allow")
    assert urlfilter.filter_urls(df, rules, listed).count() == len(rows)
    assert urlfilter.filter_urls(df.limit(0), rules, listed).count() == 0
    assert urlfilter.filter_urls(df, rules.limit(0), listed.limit(0)).where("verdict = 'allow'").count() == len(rows)


def test_long_filters_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", 10)
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = urlfilter.bloom_filter(keys, 5000)
    kept = urlfilter.possible(keys, bloom, blocks)
    assert blocks > 10 and kept.count() == 5000 and "ResolvedHint" not in kept._jdf.queryExecution().analyzed().toString()


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = urlfilter.bloom_filter(keys, 5000)
    assert urlfilter.possible(keys, bloom, blocks).count() == 5000
    others = spark.range(50_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert urlfilter.possible(others, bloom, blocks).count() < 500


# 5: personal data


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_feistel(digits, radix, key, label):
    n, half = len(digits), len(digits) // 2
    state = list(digits)
    for turn in range(pii.ROUNDS):
        left = turn % 2 == 0
        still = state[half:] if left else state[:half]
        seed = f"{key},{label},{turn},{'.'.join(map(str, still))}"
        for i in range(half) if left else range(half, n):
            h = hashlib.sha256(f"{seed}:{i // 5}".encode()).hexdigest()[i % 5 * 12 :][:12]
            state[i] = (state[i] + int(h, 16)) % radix[i]
    return state


def test_feistel_is_the_permutation_of_the_brute_force(spark):
    df = spark.range(1000).select(F.transform(F.split(F.lpad(F.col("id").cast("string"), 3, "0"), ""), lambda c: c.cast("int")).alias("d"))
    rows = df.select("d", pii.feistel(F.col("d"), F.array_repeat(F.lit(10), 3), "k", F.lit("x")).alias("e")).collect()
    assert all(r.e == brute_feistel(r.d, [10] * 3, "k", "x") for r in rows)
    assert len({tuple(r.e) for r in rows}) == 1000


def test_pseudonyms(spark):
    text = "Card 4111 1111 1111 1111, 4111-1111-1111-1111 or 4111111111111111; not 4111111111111112. On 2024-02-29, not 2023-02-29; a.Bc-1@x-y.example.com +1 (599) 555-3756 ip 10.0.0.255 not 10.0.0.256 h 0123456789abcdef0123456789abcdef."
    df = docs(spark, (1, text), (2, text), (3, None), (4, ""), (5, "nothing 12 here"), (6, LONG), (7, "@" * 1000 + "a@" * 1000), (8, "1" * 100_000))
    rows = {r.doc_id: r for r in pii.pseudonymize(clashing(df), "k").collect()}
    one = rows[1]
    assert one.text == rows[2].text != text and rows[3].text is None and rows[4].text == "" and rows[5].text == "nothing 12 here" and rows[6].text == LONG and not rows[5].pii
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    kinds = [p.kind for p in one.pii]
    assert kinds == ["card", "card", "card", "date", "email", "phone", "ip", "secret"]
    cards = [re.sub("[^0-9]", "", p.pseudonym) for p in one.pii[:3]]
    assert len(set(cards)) == 1 and luhn([int(c) for c in cards[0]]) and cards[0] != "4111111111111111"
    assert datetime.date.fromisoformat(one.pii[3].pseudonym).year // 100 == 20
    assert one.pii[4].pseudonym.endswith("@x-y.example.com") and shape(one.pii[4].pseudonym) == shape("a.Bc-1@x-y.example.com") and one.pii[5].pseudonym.startswith("+1 (")
    assert all(0 <= int(x) < 256 for x in one.pii[6].pseudonym.split(".")) and re.fullmatch("[0-9a-f]{32}", one.pii[7].pseudonym)
    for left_alone in ("4111111111111112", "2023-02-29", "10.0.0.256"):
        assert left_alone in one.text
    other = {r.doc_id: r.text for r in pii.pseudonymize(df, "other").collect()}
    assert other[1] != one.text
    assert pii.pseudonymize(df.limit(0), "k").count() == 0


def brute_iban_rest(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def brute_kind(value):
    for kind, pattern in pii.KINDS.items():
        if re.fullmatch(pattern, value):
            if kind == "card" and not luhn([int(c) for c in value if c.isdigit()]):
                return None
            if kind == "iban" and brute_iban_rest(value.replace(" ", "")) != 1:
                return None
            if kind == "date":
                try:
                    datetime.date.fromisoformat(value)
                except ValueError:
                    return None
            return kind
    return None


def brute_characters(value, key, label, letters=26, spaced=True):
    sets = ("0123456789", pii.LETTERS, pii.LETTERS.upper())
    which = {c: n for n, x in enumerate(sets) for c in x}
    known = [c for c in value if c in which]
    shape = "".join(str(which.get(c, c)) for c in value) if spaced else ""
    moved = iter(long_feistel([sets[which[c]].index(c) for c in known], [10 if which[c] == 0 else letters for c in known], key, label + shape))
    return "".join(sets[which[c]][next(moved)] if c in which else c for c in value)


def long_feistel(digits, radix, key, label):
    """As brute_feistel, with the seeds of long values hashed first."""
    n, half, state = len(digits), len(digits) // 2, list(digits)
    for turn in range(pii.ROUNDS):
        left = turn % 2 == 0
        seed = f"{key},{label},{turn},{'.'.join(map(str, state[half:] if left else state[:half]))}"
        seed = hashlib.sha256(seed.encode()).hexdigest() if n > 128 else seed
        for i in range(half) if left else range(half, n):
            h = hashlib.sha256(f"{seed}:{i // 5}".encode()).hexdigest()[i % 5 * 12 :][:12]
            state[i] = (state[i] + int(h, 16)) % radix[i]
    return state


def brute_pseudonym(value, key):
    kind = brute_kind(value)
    if kind == "email":
        local, domain = value.split("@", 1)
        return brute_characters(local, key, "email") + "@" + domain
    if kind == "secret":
        return brute_characters(value, key, "secret", 6)
    if kind == "phone":
        prefix = re.match(pii._COUNTRY, value)[0]
        return prefix + brute_characters(value[len(prefix) :], key, "phone", spaced=False)
    if kind == "ip":
        return ".".join(map(str, brute_feistel([int(x) for x in value.split(".")], [256] * 4, key, "ip")))
    if kind == "card":
        digits = [int(c) for c in value if c.isdigit()]
        n, first = len(digits), digits[:2] if len(digits) != 16 else []
        free = digits[len(first) : n - 1]
        body = first + brute_feistel(free, [10] * len(free), key, "card" + (f"{n},{first[0]}{first[1]}" if first else ""))
        check = next(c for c in range(10) if luhn([*body, c]))
        made = iter([*body, check])
        return "".join(str(next(made)) if c.isdigit() else c for c in value)
    if kind == "iban":
        account = value.replace(" ", "")
        rest = brute_characters(account[4:], key, "iban")
        made = iter(f"{account[:2]}{98 - brute_iban_rest(account[:2] + '00' + rest):02d}{rest}")
        return "".join(c if c == " " else next(made) for c in value)
    if kind == "date":
        first = datetime.date(int(value[:2]) * 100, 1, 1)
        days = (datetime.date(first.year + 100, 1, 1) - first).days
        pair = divmod((datetime.date.fromisoformat(value) - first).days, 192)
        while True:
            pair = brute_feistel(list(pair), [192] * 2, key, "date" + value[:2])
            if pair[0] * 192 + pair[1] < days:
                return (first + datetime.timedelta(pair[0] * 192 + pair[1])).isoformat()
    return value


# The usual example numbers of accounts and cards.
ACCOUNTS = "GB29 NWBK 6016 1331 9268 19 AND DE89370400440532013000, FR14 2004 1010 0505 0001 3M02 606. NO93 8601 1117 947 not DE89370400440532013001 MT84MALT011000012345MTLCAST001S"
CARDS = "3782 822463 10005, 378282246310005; 3056-930902-5904 30569309025904 6205 5000 0000 0000 004 6205500000000000004 not 378282246310006"


def test_accounts_and_cards_of_other_lengths(spark):
    rows = {r.doc_id: r for r in pii.pseudonymize(docs(spark, (1, ACCOUNTS), (2, CARDS), (3, "DE89 " * 10_000), (4, ACCOUNTS.replace(" ", "  ")), (5, "+49 30 12345678 GB29NWBK60161331926819")), "k").collect()}
    assert [p.kind for p in rows[1].pii] == ["iban"] * 5 and [p.kind for p in rows[2].pii] == ["card"] * 6
    made = [p.pseudonym for p in rows[1].pii]
    assert all(brute_iban_rest(m.replace(" ", "")) == 1 for m in made) and [m[:2] for m in made] == ["GB", "DE", "FR", "NO", "MT"]
    assert "DE89370400440532013001" in rows[1].text and "378282246310006" in rows[2].text and made[0].index(" ") == 4 and len(rows[1].text) == len(ACCOUNTS)
    cards = [re.sub("[^0-9]", "", p.pseudonym) for p in rows[2].pii]
    assert all(luhn([int(c) for c in x]) for x in cards) and cards[0] == cards[1] != "378282246310005" and cards[2] == cards[3] and cards[4] == cards[5]
    assert [x[:2] for x in cards[::2]] == ["37", "30", "62"] and not rows[3].pii
    assert [p.kind for p in rows[5].pii] == ["phone", "iban"] and rows[5].pii[1].pseudonym == made[0].replace(" ", "")


def test_whole_texts_match_brute_force(spark):
    """Finding, replacing and putting together, on all test texts and on some with every kind."""
    extra = ["a@b.cc 4111 1111 1111 1111 2024-02-29 10.1.2.3 +49 (30) 1234-5678 " + "0123456789abcdef" * 20, "x" * 50 + "@" + "y.z" * 3, "2000-01-01,2099-12-31;1999-12-31 +1 555 1234567 1.2.3.4.5 _q@r.st_", ACCOUNTS, CARDS]
    frame = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - n, t) for n, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in frame.collect()}
    found = 0
    for r in pii.pseudonymize(frame, "a key").collect():
        text = texts[r.doc_id]
        values = [m[0] for m in re.finditer(pii.PATTERN, text)] if re.search(pii.HINT, text) else []
        assert r.text == re.sub(pii.PATTERN, lambda m: brute_pseudonym(m[0], "a key"), text)
        assert [(p.kind, p.length, p.pseudonym) for p in r.pii] == [(brute_kind(v), len(v), brute_pseudonym(v, "a key")) for v in values if brute_kind(v)]
        found += len(r.pii)
    assert found > 100


@pytest.mark.parametrize("piece", ["b.", "a@b.", "a@", "1", "1-", "1.", "+1 ", "4111 ", "2020-01-", "DE12 ", "aA0", "%", "1111-", "a-b."])
def test_a_megabyte_of_what_patterns_repeat(spark, piece):
    """No text is too long for the patterns; what is found is what Python's matcher finds."""
    texts = [pre + piece * (1_000_000 // len(piece)) + end for pre, end in (("", "com"), ("a@", "com"), ("x ", " john@x.org"))]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(df, "a key").collect()}
    assert all(len(out[n].text) == len(t) for n, t in enumerate(texts))
    assert "john" not in out[2].text and [p.kind for p in out[2].pii][-1] == "email"


def test_secrets_of_any_case_and_length(spark):
    tokens = ["9233A8EC" * 4, "0123456789abcdef" * 8, "AbCdEf01" * 5, "c0ffee" * 200]
    df = docs(spark, (1, f'TOKEN = "{tokens[0]}" {tokens[1]}, {tokens[2]}'), (2, tokens[3]), (3, "g" + tokens[0]), (4, tokens[0][:31]), (5, tokens[0]), (6, "A" * 100_000 + "g"))
    rows = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    made = [p.pseudonym for n in (1, 2) for p in rows[n].pii]
    case = lambda t: re.sub("[a-f]", "a", re.sub("[A-F]", "A", re.sub("[0-9]", "0", t)))
    assert [p.kind for n in (1, 2) for p in rows[n].pii] == ["secret"] * 4 and [case(m) for m in made] == [case(t) for t in tokens]
    assert not any(t in rows[n].text for t in tokens for n in (1, 2, 5)) and rows[5].text == made[0]
    assert not rows[3].pii and not rows[4].pii and not rows[6].pii


def test_phones_end_before_other_numbers_and_link(spark):
    phone = "+1 (826) 555-4081"
    texts = [phone, f"{phone} 190.137.223.204", f"{phone} 4111 1111 1111 1111", f"{phone} 2024-02-29", f"{phone} 190.5", "+1 826 555 4081", "+18265554081", "+44 20 7946 0958"]
    rows = {r.doc_id: r for r in pii.pseudonymize(docs(spark, *enumerate(texts)), "k").collect()}
    kinds = [[p.kind for p in rows[n].pii] for n in range(len(texts))]
    assert kinds == [["phone"], ["phone", "ip"], ["phone", "card"], ["phone", "date"], ["phone"], ["phone"], ["phone"], ["phone"]]
    made = rows[0].pii[0].pseudonym
    assert made != phone and all(rows[n].pii[0].pseudonym == made for n in range(5)) and "137.223.204" not in rows[1].text and rows[4].text.endswith(" 190.5")
    digits = lambda t: re.sub("[^0-9]", "", t)
    assert digits(rows[5].text) == digits(rows[6].text) == digits(made)


def test_addresses_after_marks(spark):
    texts = ["_john@x.com_", "-john@x.com", "...john@x.com", "%+john@x.com", "see +john.doe@x.com.", "._%+-" * 20_000]
    rows = {r.doc_id: r for r in pii.pseudonymize(docs(spark, *enumerate(texts)), "k").collect()}
    assert all([p.kind for p in rows[n].pii] == ["email"] and "john" not in rows[n].text and "@x.com" in rows[n].text for n in range(5))
    assert rows[0].text[0] == rows[0].text[-1] == "_" and rows[2].text.startswith("...") and rows[5].text == texts[5]


def test_dates_are_permuted_within_their_century(spark):
    days = spark.range(0, 36525, 7).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    made = [r[0] for r in days.select(pii.pseudonym(F.col("d"), F.lit("date"), "k")).collect()]
    assert len(set(made)) == len(made) and all("2000-01-01" <= m <= "2099-12-31" for m in made)


def test_no_python_on_the_native_paths(spark):
    for df in (queries.op5_pii(spark, SF), queries.op10_shards(spark, SF)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# 6: LM scoring


def test_scores_match_brute_force(spark):
    frame = queries.table(spark, SF, "documents").select("doc_id", "text")
    good = {r.doc_id for r in queries.table(spark, SF, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    texts = {r.doc_id: r.text for r in frame.collect()}
    frequent = Counter(c for t in texts.values() for c in t)
    names = {c: n + 1 for n, c in enumerate(sorted(frequent, key=lambda c: (-frequent[c], ord(c)))[: lmscore.SYMBOLS - 2])}
    v, end = lmscore.SYMBOLS, lmscore.BOUNDARY
    coded = {d: [end, end, *(names.get(c, 0) for c in t)] for d, t in texts.items()}

    def model(ids, tokens):
        n3, n2, n1 = Counter(), Counter(), Counter()
        c2, c1 = Counter(), Counter()
        scale = tokens / sum(len(texts[d]) for d in ids)
        for d in ids:
            s = coded[d]
            for a, b, c in zip(s, s[1:], s[2:]):  # noqa: B905
                n3[a, b, c] += scale
                n2[b, c] += scale
                n1[c] += scale
                c2[a, b] += scale
                c1[b] += scale
        total = sum(n1.values())

        def loss(a, b, c):
            p1 = (n1[c] + 1) / (total + v)
            p2 = (n2[b, c] + lmscore.PRIOR * p1) / (c1[b] + lmscore.PRIOR)
            return -math.log((n3[a, b, c] + lmscore.PRIOR * p2) / (c2[a, b] + lmscore.PRIOR))

        return loss

    tokens = sum(len(texts[d]) for d in set(texts) & good)
    target, background = model(set(texts) & good, tokens), model(set(texts) - good, tokens)
    rows = {r.doc_id: r for r in queries.op6_lm_score(spark, SF).collect()}
    assert set(rows) == set(texts)
    for d in list(texts)[:25]:
        s = coded[d]
        t = [target(*x) for x in zip(s, s[1:], s[2:])]  # noqa: B905
        b = [background(*x) for x in zip(s, s[1:], s[2:])]  # noqa: B905
        assert rows[d].n_tokens == len(t) and rows[d].target_loss == pytest.approx(sum(t) / len(t), abs=2e-5) and rows[d].background_loss == pytest.approx(sum(b) / len(b), abs=2e-5)


def test_scores_tell_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = queries.table(spark, sf, "labels").toPandas()
    fit = labels[(labels.doc_id % 2 == 0) & (labels.quality == 1)]
    held = labels[labels.doc_id % 2 == 1]
    out = lmscore.cross_entropy_difference(queries.table(spark, sf, "documents"), spark.createDataFrame(fit[["doc_id"]])).toPandas().merge(held, on="doc_id")
    good, bad = out[out.quality == 1].difference, out[out.quality == 0].difference
    assert np.mean([g < b for g in good for b in bad]) > 0.9


def test_scores_of_odd_rows(spark):
    rows = odd_rows(spark)
    targets = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    got = lmscore.cross_entropy_difference(clashing(rows), targets).collect()
    assert len(got) == 11 and all((r.n_tokens == 0) == (r.difference is None) for r in got)
    assert lmscore.cross_entropy_difference(rows.limit(0), targets).count() == 0
    none = lmscore.cross_entropy_difference(rows, targets.limit(0))
    assert none.count() == 11 and none.where("difference <> 0").count() == 0
    assert lmscore.cross_entropy_difference(rows, rows.select("doc_id")).count() == 11


def test_copies_of_the_background_do_not_move_scores(spark):
    """The models are matched: a background of the same texts ten times over is the same model."""
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    good, rest = [(n, text("abcdefg")) for n in range(20)], [(n, text("defghij")) for n in range(20, 40)]
    targets = spark.createDataFrame([(n,) for n, _ in good], "doc_id long")
    scores = lambda rows: {r.doc_id: r.difference for r in lmscore.cross_entropy_difference(docs(spark, *rows), targets).collect()}
    assert scores(good + rest) == pytest.approx(scores(good + rest * 10), abs=2e-6)


def test_characters_beyond_the_first_hundreds_stay_apart(spark):
    # about 2,000 ideographs, those of the target not among the most frequent ones: a capped vocabulary would make them one symbol
    rare = ["".join(chr(0x5000 + (17 * i * n + n) % 1500) for i in range(400)) for n in range(1, 13)]
    often = ["".join(chr(0x4E00 + (13 * i * n + n) % 500) for i in range(3000)) for n in range(1, 13)]
    texts = [x for x in [*rare, *often] for _ in range(2)]
    df = docs(spark, *enumerate(texts)).repartition(3)
    got = lmscore.cross_entropy_difference(df, spark.createDataFrame([(n,) for n in range(0, 12, 2)], "doc_id long"))
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[n].n_tokens == len(t) for n, t in enumerate(texts))
    # the copies of target documents are known to the target, other texts of the same characters are not
    assert max(rows[n].difference for n in range(12)) < min(rows[n].difference for n in range(12, 24)) - 1
    assert max(rows[n].difference for n in range(24)) < min(rows[n].difference for n in range(24, 48)) - 1


def test_blocks_do_not_change_scores(spark, monkeypatch):
    frame = queries.table(spark, SF, "documents").select("doc_id", "text").limit(200)
    targets = frame.where("doc_id % 3 = 0").select("doc_id")
    whole = sorted(map(tuple, lmscore.cross_entropy_difference(frame, targets).collect()))
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(lmscore, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, lmscore.cross_entropy_difference(frame, targets).collect())) == whole


# 7: quality rules


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    tri = list(zip(w, w[1:], w[2:]))  # noqa: B905
    n = Counter(tri)
    inside = {j for i, t in enumerate(tri) if n[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("text", ["", None, "a b c a b c", "a a a a", "x\n\nx\n \nx\ny", "##|| é\u00a0b <>", "a b c d a b c d a b", "l\r\nl\r\nl", "a b c x b c x b c"])
def test_text_counts(text):
    assert quality.text_stats(text)[:5] == brute_stats(text)


def test_quality_counts_and_estimates(spark):
    sf = "/root/testdata/sf0.01"
    frame = queries.table(spark, sf, "documents").toPandas()
    rows = queries.op7_quality(spark, sf).toPandas().merge(frame, on="doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(x) for x in rows[names].itertuples(index=False)] == [brute_stats(t) for t in rows.text]
    assert (rows.base_failed == ((rows.n_words < 50) | (100 * rows.n_repeat_words > 50 * rows.n_words))).all()

    # the estimates again, with numpy: groups of their own, and languages whose small groups are pooled
    x, r = (np.array([quality.text_stats(t)[k] for t in rows.text]) / quality.SCALE for k in (5, 6))
    good = ~rows.base_failed
    sizes = rows[good].groupby(["lang", "source"]).size()
    small = np.array([sizes.get(k, 0) < quality.MIN_GROUP for k in zip(rows.lang, rows.source, strict=True)])
    places = [(rows.lang == lang) & small for lang in rows.lang.dropna().unique()] + [(rows.lang == k[0]) & (rows.source == k[1]) for k, n in sizes.items() if n >= quality.MIN_GROUP]
    dets = []
    for place in places:
        used = place & good
        own = {}
        for source, k, q in zip(pd.factorize(rows.source)[0][used], x[used], r[used], strict=True):
            own[(*k, source)] = min(tuple(q), own.get((*k, source), (math.inf,)))
        center, scatter, det, noise = brute_mcd(np.array(list(own))[:, : quality.D], np.array(list(own.values())))
        want = brute_distance(x[place], r[place], center, scatter, noise)
        assert np.allclose(rows[place].distance, want, rtol=1e-6)
        dets.append(det)
    assert len(dets) >= 4 and len({round(d, 3) for d in dets}) == len(dets)
    assert (rows.kept == (~rows.base_failed & (rows.distance <= quality.CUTOFF))).all()


def brute_distance(x, r, center, scatter, noise):
    off, out = x - center, []
    for o, own in zip(off, np.minimum(r**2, noise), strict=True):
        out.append(o @ np.linalg.inv(scatter - np.diag(noise) + np.diag(own)) @ o)
    return np.array(out)


def brute_mcd(own, r):
    """Centre, scatter, log-determinant and noise of distinct vectors: three starts, concentration to the end, the smallest determinant."""
    d = quality.D
    noise = (r**2).mean(axis=0)
    low, mid, high = (np.percentile(own, q, axis=0) for q in (25, 50, 75))
    spread = np.sqrt(((high - low) / 1.349) ** 2 + noise)
    z = (own - mid) / spread
    signs = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    starts = [(mid, np.diag(spread**2)), (mid, np.outer(spread, spread) * (signs.T @ signs) * d / len(own) + np.diag(noise)), (own.mean(0), np.cov(own.T, bias=True) + np.diag(noise))]
    ends = []
    for center, scatter in starts:
        best = math.inf
        for _ in range(quality.STEPS):
            off = own - center
            bins = np.floor(64 * np.log2(1 + np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off)))
            last = np.sort(bins)[int(np.ceil(quality.CORE * len(own))) - 1]
            core = own[bins <= last]
            new = quality.consistency() * np.cov(core.T, bias=True) + np.diag(noise)
            det = np.linalg.slogdet(new)[1]
            if not det < best - quality.LEAST_FALL:
                break
            center, scatter, best = core.mean(0), new, det
        ends.append((best, center, scatter))
    least = min(e[0] for e in ends)
    det, center, scatter = next(e for e in ends if e[0] <= least + quality.TIE)
    return center, scatter, det, noise


def test_scatters_are_estimates_of_their_groups(spark):
    """The core's scatter, not the resolution that keeps it regular, makes the determinants: they differ by group, and follow the data when it is spread out."""
    rows = queries.table(spark, "/root/testdata/sf0.1", "documents").select("lang", "source", quality.stats("text").alias("s"))
    rows = rows.where(~quality.base_failed(F.col("s"))).select(F.col("lang").alias("language"), "source", "s.x", "s.r")
    estimates, n = quality.fit(rows)
    found = estimates.toPandas()
    assert len(found) == n >= 60
    noise_alone = np.log(np.array(found.noise.tolist())).sum(axis=1)
    assert (found.log_det > noise_alone + 1).mean() > 0.9
    assert found.log_det.round(6).nunique() > 0.5 * n
    # of word lengths, which every text has, nearly all of the variance is the data's
    variances = np.linalg.inv(np.array(found.inverse.tolist()).reshape(-1, quality.D, quality.D))[:, 0, 0]
    assert (np.array(found.noise.tolist())[:, 0] < 0.2 * variances).mean() > 0.9


def test_estimate_of_a_group_of_its_own(spark):
    """A language and source with enough texts, some of them far off: the estimate is that of numpy and the far ones go."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    good = [" ".join(word(rng.randrange(3, 9)) for _ in range(rng.randrange(60, 300))) for _ in range(160)]
    bad = [" ".join(word(rng.randrange(18, 30)).upper() + "$#|" for _ in range(rng.randrange(60, 200))) for _ in range(12)]
    rows = docs(spark, *[(n, t, "en", "s") for n, t in enumerate(good + bad)], *[(n + 500, t, "en", "other") for n, t in enumerate(good[:70])])
    out = quality.quality_rules(rows, ["doc_id"]).where("doc_id < 500").toPandas().sort_values("doc_id")
    x, r = (np.array([quality.text_stats(t)[k] for t in good + bad]) / quality.SCALE for k in (5, 6))
    own = {}
    for k, q in zip(map(tuple, x), map(tuple, r), strict=True):
        own[k] = min(q, own.get(k, (math.inf,)))
    center, scatter, _, noise = brute_mcd(np.array(list(own)), np.array(list(own.values())))
    assert np.allclose(out.distance, brute_distance(x, r, center, scatter, noise), rtol=1e-6)
    assert out.kept.tolist() == [True] * 160 + [False] * 12


def test_repeated_lines_alone_can_reject(spark):
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    plain = ["\n".join(line(rng.randrange(6, 14)) for _ in range(12)) for _ in range(120)]
    same = line(1)
    odd = "\n".join(x for _ in range(30) for x in (same, same, same, line(9)))
    out = quality.quality_rules(docs(spark, *[(n, t, "en", "s") for n, t in enumerate([*plain, odd])]), ["doc_id"]).toPandas().sort_values("doc_id")
    assert out.kept.tolist() == [True] * 120 + [False] and not out.base_failed.iloc[-1]


def test_quality_keeps_good_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").toPandas()
    assert not rows[rows.quality == 0].kept.any() and rows[(rows.quality == 1) & ~rows.base_failed].kept.mean() >= 0.95


def test_quality_of_odd_rows(spark):
    rows = clashing(odd_rows(spark))
    out = quality.quality_rules(rows, ["doc_id"])
    assert out.count() == 11 and out.where("kept").count() == 0
    good = docs(spark, *[(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", None) for i in range(3)])
    assert quality.keep_good(clashing(good.unionByName(odd_rows(spark)))).columns == rows.columns
    assert quality.keep_good(good.unionByName(odd_rows(spark))).count() == 3
    assert quality.keep_good(rows.limit(0)).count() == 0


def test_copies_do_not_pull_the_estimate(spark):
    """A third and more of a group are copies of one text; the others stay."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 200)))
    copy = text()
    rows = docs(spark, *[(i, copy if i % 5 < 3 else text(), "en", "s") for i in range(400)])
    assert quality.keep_good(rows).count() == 400


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200_000, quality.D))
    d = (x**2).sum(1)
    core = x[d <= np.quantile(d, quality.CORE)]
    assert quality.consistency() * core.var() == pytest.approx(1, rel=0.02)


# 8: licenses


def brute_licenses(texts):
    """(license, cosine) of each text: every run of lines and terms against every template, with frequencies of all terms."""
    seen = Counter(t for text in texts for t in set(licenses.terms(text or "")))
    vector = lambda found: {t: c * licenses.idf(len(texts), seen[t]) for t, c in Counter(found).items()}
    templates = [(name, licenses.terms(text)) for name, text in licenses.TEMPLATES]
    vectors = [vector(found) for _, found in templates]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for text in texts:
        lines = [x for x in (licenses.terms(x) for x in (text or "").split("\n")) if x]
        found = licenses.terms(text or "")
        by_lines = [[t for x in lines[a : a + k] for t in x] for k in range(1, licenses.WINDOW + 1) for a in range(len(lines) - k + 1)]
        best = (0.0, 0)
        for n, (_, words) in enumerate(templates):
            size = min(len(words), len(found))
            for run in by_lines + [found[a : a + size] for a in range(len(found) - size + 1)]:
                if not set(run).isdisjoint(words):
                    v = vector(run)
                    cosine = round(sum(x * vectors[n].get(t, 0) for t, x in v.items()) / norm(v) / norm(vectors[n]), 6)
                    best = max(best, (cosine, -n))
        name = templates[-best[1]][0] if best[0] >= licenses.THRESHOLD else None
        out.append((name, best[0] if name else None))
    return out


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("path", F.concat(F.lit("d"), "doc_id", F.lit("/x.txt")))
    return {r.doc_id: (r.license, r.cosine) for r in licenses.scan_licenses(rows, ["doc_id"]).collect()}


def test_licenses_match_brute_force(spark):
    """Statements inside and across lines, changed by words that the templates do not have, in texts that make common words common."""
    rng = random.Random(4)
    plain = "the of is this by to in and a file work license copy notice under software".split()
    noise = lambda n: [rng.choice([*plain, *(f"zz{i}" for i in range(30))]) for _ in range(n)]
    texts = [None, "", "the of is this by to", " ".join(noise(200))]
    for n in range(70):
        words = rng.choice(licenses.STATEMENTS if rng.random() < 0.8 else licenses.TEXTS)[1].split()
        for _ in range(rng.randrange(4) if n % 3 else 0):
            words.insert(rng.randrange(len(words)), rng.choice([*plain, "zz1", "zz2", f"once{n}"]))
        whole = noise(rng.randrange(12)) + words + noise(rng.randrange(12))
        texts.append("".join(w + ("\n" if rng.random() < (0, 0.1, 0.5)[n % 3] else " ") for w in whole))
    texts += ["MIT License", "Copyright 2020 X. All rights reserved. MIT License", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Everyone", "License license\nLicense\nmit mit Rights"]
    want = brute_licenses(texts)
    got = scanned(spark, texts)
    assert [got[n][0] for n in range(len(texts))] == [w[0] for w in want]
    assert all(got[n][1] == pytest.approx(w[1], abs=2e-6) if w[0] else got[n][1] is None for n, w in enumerate(want))
    assert sum(0.8 <= (w[1] or 0) < 0.9999 for w in want) > 15


def test_statements(spark):
    narrow = "\n".join(f" * {w}" for w in ("x y z " + licenses.TEMPLATES[7][1] + ", or any later one").split())
    texts = {
        "text\nReleased under the MIT License.\nmore": "MIT", "// Licensed under the Apache License,\n// Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Copyright (c) 2020 Acme Corp. All rights reserved.": "LicenseRef-all-rights-reserved", "The code is released under the MIT License, see the file LICENSE for details.": "MIT", narrow: "GPL-3.0",
        " ".join(licenses.TEXTS[0][1].split()): "MIT", "Copyright 1999 A B\n\n" + licenses.TEXTS[1][1]: "BSD-3-Clause", licenses.TEXTS[2][1].replace("\n", "\n# "): "ISC", "w " * 85 + "Released under the MIT License. " + "v " * 85: "MIT",
        "nothing is said here": None,
    }
    got = scanned(spark, list(texts))
    assert [got[n][0] for n in range(len(texts))] == list(texts.values())


def test_a_title_is_no_grant(spark):
    """Prose that names a license has none by it; a license file that holds a title and no statement has that license, without a cosine."""
    named = {
        "This file is not under the MIT License and never was": "MIT", "We compared Apache License 2.0 with the GNU General Public License version 3 for our book.": "Apache-2.0",
        "MIT License": "MIT", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Everyone": "GPL-3.0", "no title": None,
    }
    rows = [(i, f"d{i}/{name}", text) for i, (text, name) in enumerate((t, n) for t in named for n in ("x.txt", "LICENSE"))]
    rows.append((99, "all/LICENSE", "Copyright 2020 X. All rights reserved. MIT License"))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), ["doc_id"]).collect()}
    for i, path, text in rows[:-1]:
        r, own = got[i], path.endswith("LICENSE") and named[text]
        assert r.named == named[text] and r.cosine is None
        # x.txt lies in a directory of its own, without a license file
        assert (r.license, r.origin) == ((named[text], "title") if own else (None, "none"))
    assert (got[99].license, got[99].origin, got[99].cosine) == ("MIT", "title", None)


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit), ("a/x.txt", "none"), ("a/b/LICENSE.txt", gpl), ("a/b/c/d/y.txt", "none"), ("a/b/own.txt", mit), ("ab/z.txt", None), ("top.txt", ""), (None, "none"), ("a/b/COPYING", "no statement"),
        ("a/x.txt", "none"), ("q/notalicense", gpl), ("q/w.txt", "none"), ("long.txt", LONG),
    ]
    df = clashing(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string"))
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in licenses.scan_licenses(df, ["doc_id"]).collect()}
    assert got[0] == ("MIT", "header", None) and got[1] == got[9] == ("MIT", "inherited", "") and got[2][:2] == ("GPL-3.0", "header")
    assert got[3] == ("GPL-3.0", "inherited", "a/b") and got[4][:2] == ("MIT", "header") and got[5] == got[6] == ("MIT", "inherited", "")
    assert got[7] == (None, "none", None) and got[8] == ("GPL-3.0", "inherited", "a/b") and got[11] == ("MIT", "inherited", "") and len(got) == len(rows)
    assert licenses.scan_licenses(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("piece", ["a-", "a.", "a", "0-9.", "- ", "MIT License ", "under the "])
def test_terms_of_a_megabyte(spark, piece):
    rows = spark.createDataFrame([(1, "d/x", piece * (1_000_000 // len(piece)) + "a")], "doc_id long, path string, text string")
    assert licenses.document_frequencies(rows).count() >= 1
    if piece != "a.":
        assert licenses.scan_licenses(rows, ["doc_id"]).count() == 1


def test_planted_statements_are_found(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    lines = {"GPL-3.0": "GNU General Public License, version 3.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License", "CC-BY-NC-4.0": "CC BY-NC 4.0", "LicenseRef-all-rights-reserved": "All rights reserved."}
    for r in queries.op8_licenses(spark, sf).collect():
        held = {k for k, s in lines.items() if s in texts[r.doc_id]}
        assert (r.origin == "header") == bool(held) and (not held or r.license in held)


# 10: sharding


def test_shards(spark):
    rows = queries.op10_shards(spark, "/root/testdata/sf0.01").toPandas()
    frame = queries.table(spark, "/root/testdata/sf0.01", "documents").toPandas()
    import zlib

    rows = rows.merge(frame[["doc_id", "text"]], on="doc_id")
    assert len(rows) == 1000 and (rows["size"] == [len(t.encode()) + 1 for t in rows.text]).all() and (rows.text_crc32 == [zlib.crc32(t.encode()) for t in rows.text]).all()
    load = rows.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(8)) and load.max() - load.min() < 0.01 * load.mean()
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_growing_moves_slots_to_the_new_shard_only(spark, tmp_path):
    sizes = spark.range(shards.SLOTS).select(F.col("id").cast("int").alias("slot"), (F.col("id") % 97 + 1).alias("bytes"))
    first = shards.slot_map(sizes, 4)
    shards.store_map(first, str(tmp_path / "map"))
    shards.store_map(shards.grown(shards.load_map(spark, str(tmp_path / "map"))), str(tmp_path / "map"))
    old, new = (shards.load_map(spark, str(tmp_path / "map"), v).toPandas().set_index("slot").sort_index() for v in (0, None))
    assert set(new.version) == {1} and len(new) == shards.SLOTS
    moved = old.shard != new.shard
    assert set(new.shard[moved]) == {4} and set(old.shard) == {0, 1, 2, 3}
    load = new.groupby("shard")["bytes"].sum()
    assert load.max() - load.min() < 0.03 * load.mean() and old.groupby("shard")["bytes"].sum().max() - old.groupby("shard")["bytes"].sum().min() <= 1


def test_slots_deal_like_greedy_brute_force(spark):
    rng = random.Random(1)
    size = {s: rng.randrange(1000) for s in range(shards.SLOTS)}
    load, want = [0] * 5, {}
    for s in sorted(size, key=lambda s: (-size[s], s)):
        i = load.index(min(load))
        load[i] += size[s]
        want[s] = i
    df = spark.createDataFrame(list(size.items()), "slot int, bytes long")
    assert {r.slot: r.shard for r in shards.slot_map(df, 5).collect()} == want


def test_shards_of_odd_rows(spark):
    rows = clashing(odd_rows(spark))
    out = shards.shard_by_slots(rows, ["doc_id", "text"], F.octet_length("text"), 3)
    assert out.count() == 11 and set(out.columns) == set(rows.columns) and out.where("size is null").count() == 0
    got = defaultdict(list)
    for r in out.collect():
        got[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in got.values())
    assert shards.shard_by_slots(rows.limit(0), ["doc_id"], F.lit(1), 3).count() == 0
