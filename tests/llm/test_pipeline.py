"""The pipeline against brute force, stage by stage."""

from collections import Counter

import corpus_pipeline as P
from test_llm_operators import brute_targets, shingle_set, WORD

from postsieve.llm import queries
from postsieve.llm.common import saved

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = P.table(spark, SF, "documents")
    first = P.STAGES[0][1](spark, docs, SF)
    assert first.columns == COLUMNS
    kept = {r.doc_id for r in queries.op7_quality(spark, SF).where("kept").collect()}
    first = saved(first, "t")
    texts = {r.doc_id: r.text for r in first.collect()}
    assert set(texts) == kept

    second = saved(P.STAGES[1][1](spark, first, SF), "t")
    assert second.columns == COLUMNS
    left = {r.doc_id for r in second.collect()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    index, links = {}, {d: {d} for d in sets}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in index[g]).items():
            if n >= 0.8 * (len(s) + len(sets[e]) - n) - 1e-9:
                links[d].add(e)
    want, seen = set(), set()
    for d in sorted(sets):
        if d not in seen:
            want.add(d)
            stack = [d]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += links[x]
    assert left == want and second.count() == len(want)

    third = saved(P.STAGES[2][1](spark, second, SF), "t")
    items = [shingle_set(r.text) for r in P.table(spark, SF, "benchmark").collect()]
    clean = {d for d in left if not any(len(i & sets[d]) >= 0.8 * len(i) - 1e-9 for i in items)}
    assert third.columns == COLUMNS and {r.doc_id for r in third.collect()} == clean and third.count() == len(clean)

    fourth = saved(P.STAGES[3][1](spark, third, SF), "t")
    assert fourth.columns == COLUMNS
    rows = third.select("doc_id", "source", "text").toPandas()
    rows["size"] = [len(WORD.findall(t)) for t in rows.text]
    targets = brute_targets(rows.groupby("source")["size"].sum().to_dict())
    taken = fourth.select("doc_id", "source").toPandas().merge(rows[["doc_id", "size"]], on="doc_id")
    for source, got in taken.groupby("source")["size"].sum().items():
        assert abs(got - targets[source]) <= 0.02 * targets[source]
    assert max(Counter(taken.doc_id).values()) <= 2

    last = P.STAGES[4][1](spark, fourth, SF).toPandas()
    assert Counter(last.doc_id) == Counter(taken.doc_id)
    load = last.groupby("shard")["size"].sum()
    assert load.max() - load.min() < 0.01 * load.mean()
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in last.groupby("shard"))


def test_odd_rows(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "en", "s", 1)] * 2 + [(None, " ".join(f"v{i}" for i in range(60)), None, None, None), (2, None, "en", None, None), (3, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, want in ((docs, 2), (docs.limit(0), 0)):
        for name, stage in P.STAGES[:3]:
            frame = saved(stage(spark, frame, SF), "odd")
            assert frame.columns == COLUMNS, name
        assert frame.count() == want
        mixed = saved(P.STAGES[3][1](spark, frame, SF), "odd")
        assert mixed.columns == COLUMNS
        # a source of one document has the target of at most twice its words
        copies = Counter(r.text for r in mixed.collect())
        assert set(copies) <= {r.text for r in frame.collect()} and all(1 <= n <= 2 for n in copies.values()) and bool(copies) == bool(want)
        last = P.STAGES[4][1](spark, mixed, SF)
        assert {"size", "shard", "slot"} <= set(last.columns)
        placed = last.toPandas()
        assert len(placed) == mixed.count() and placed["size"].sum() == sum(n * (len(t) + 1) for t, n in copies.items())
        assert all(sorted(p.slot) == list(range(len(p))) for _, p in placed.groupby("shard"))


def test_texts_that_share_an_id(spark):
    """No unique text is lost over an id that a copy has too."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("A")), (2, text("A")), (2, text("B")), (3, text("C")), (3, text("D"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = P.STAGES[1][1](spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [rows[0], *rows[2:]]
