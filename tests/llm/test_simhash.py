"""SimHash groups against brute force and odd rows."""

import random

import numpy as np
import pytest
import xxhash
from test_llm_operators import WORD, clashing, docs, odd_rows

from postsieve.llm import queries, simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """For each fingerprint of a list, the first position that links reach."""
    u, at = np.unique(np.array(fps, np.uint64), return_inverse=True)
    root, stack = {}, []
    for start in range(len(u)):
        if start in root:
            continue
        root[start], stack = start, [start]
        while stack:
            n = stack.pop()
            for m in np.flatnonzero(np.bitwise_count(u ^ u[n]) <= 4).tolist():
                if m not in root:
                    root[m] = start
                    stack.append(m)
    first = {}
    for pos, node in enumerate(at.tolist()):
        first.setdefault(root[node], pos)
    return [first[root[node]] for node in at.tolist()]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b", "Ä É ß b C", "a\x0bb\x0cc d e", "x " * 70_000, "To be or not to be, that is the question " * 3])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_groups_match_brute_force(spark, size):
    sf = f"/root/testdata/{size}"
    found = queries.op13_simhash(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in texts.text]
    assert found.doc_id.tolist() == texts.doc_id.tolist() and found.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    ids = texts.doc_id.tolist()
    assert found.component_id.tolist() == [ids[p] for p in brute_components(fps)]


def linked_components(spark, fps):
    """The smallest position that each distinct fingerprint reaches over the links that are found."""
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = [tuple(int(np.int64(v).view(np.uint64)) for v in row) for row in simhash.links(nodes).collect()]
    for a, b in edges:
        root[find(a)] = find(b)
    first = {}
    for pos, f in enumerate(fps):
        first.setdefault(find(int(f)), pos)
    return [first[find(int(f))] for f in fps], edges


@pytest.mark.parametrize("large", [4, 64])
def test_links_of_clusters_in_blocks(spark, monkeypatch, large):
    """Chains and balls of fingerprints, many of which share segments, cut into very small blocks."""
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(30):
            x = center
            for _ in range(rng.randrange(0, 9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    step = rng.getrandbits(64)
    for _ in range(40):
        step ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(step)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << b) ^ (1 << c) for b in range(43, 64) for c in range(43, 64)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "_LARGE", large)
    found, edges = linked_components(spark, fps)
    assert found == brute_components(fps)
    # forests, not pairs: no key and pair of blocks gives as many links as rows
    assert len(edges) < 20 * len(fps)


def test_links_of_each_distance(spark):
    """Bits that differ in every way that four bits fall on the segments are linked; five bits apart are not."""
    rng = random.Random(3)
    for n, linked in ((1, True), (2, True), (3, True), (4, True), (5, False)):
        pairs = []
        for _ in range(150):
            a = rng.getrandbits(64)
            pairs += [a, a ^ sum(1 << b for b in rng.sample(range(64), n))]
        found, _ = linked_components(spark, pairs)
        assert all((found[i] == found[i + 1]) == linked for i in range(0, len(pairs), 2))


def test_simhash_of_odd_rows(spark):
    rows = odd_rows(spark)
    found = simhash.simhash_groups(clashing(rows)).collect()
    assert len(found) == rows.count()
    assert {r.fingerprint for r in found if r.doc_id in (2, 3, 4)} == {"0" * 16}
    # null ids take part and are named by others: those without words by 2, the copies of 1 by 1
    assert sorted(r.component_id for r in found if r.doc_id is None) == [1, 2]
    assert sorted(found, key=str) == sorted(simhash.simhash_groups(rows).collect(), key=str)
    assert simhash.simhash_groups(rows.limit(0)).count() == 0
    alone = simhash.simhash_groups(docs(spark, (None, "a b", None, None))).collect()
    assert [tuple(r)[::2] for r in alone] == [(None, None)]
