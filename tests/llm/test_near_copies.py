"""Near copies by Jaccard likeness against a brute-force search."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from logfault.llm import near_copies as N

FOLDER = "/root/testdata"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_links(sets):
    """All pairs of different sets with a likeness of 0.8 or more."""
    sets = list(sets)
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    found = []
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j > i)
        found += [(s, sets[j]) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
    return found


def brute_groups(texts):
    """Group of each id, as the smallest id of it."""
    members = defaultdict(list)
    for i, t in texts.items():
        members[shingles(t)].append(i)
    parent = {s: s for s in members}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = brute_links(members)
    for a, b in links:
        parent[find(a)] = find(b)
    first = defaultdict(lambda: 1 << 62)
    for s, ids in members.items():
        first[find(s)] = min(first[find(s)], *ids)
    return {i: first[find(s)] for s, ids in members.items() for i in ids}, links


def kept_and_groups(spark, size):
    docs = spark.read.parquet(f"{FOLDER}/{size}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    group, links = brute_groups(texts)
    return {r.doc_id for r in N.first_of_near_copies(docs).select("doc_id").collect()}, texts, group, links


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, size):
    kept, texts, group, links = kept_and_groups(spark, size)
    first = set(group.values())
    assert first <= kept  # no clean document and no first one goes
    copies = {shingles(texts[i]) for i in texts if i not in first}
    print(size, len(texts), "kept", len(kept), "groups", len(first), "links", len(links))
    assert len(kept - first) <= 0.1 * len(copies)
    by_set = defaultdict(list)
    for i, t in texts.items():
        by_set[shingles(t)].append(i)
    gone = sum(not (min(by_set[a]) in kept and min(by_set[b]) in kept) for a, b in links)
    print("links of which one text has gone", gone)
    assert gone >= 0.9 * len(links)
    assert all(len(kept & set(ids)) <= 1 for ids in by_set.values())


def edited(rng, words, share):
    """``words`` with about this share of its shingles of five changed."""
    out = list(words)
    for at in rng.sample(range(len(out)), max(1, round(share * len(out) / 5))):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def test_large_group(spark, monkeypatch):
    """Edited copies of one text, in cells that are split: one stays; texts below 0.8 stay."""
    from logfault.llm import simhash
    monkeypatch.setattr(simhash, "PROBE", 1)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 0.08))) for i in range(1, 600)]
    rows += [(1000 + i, " ".join(edited(rng, base, 1.0))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    left = {r.doc_id for r in N.first_of_near_copies(docs, cell=100).collect()}
    assert {i for i in left if i < 1000} == {0}
    assert {i for i in left if i >= 1000} == set(range(1000, 1020))


def test_forest_connects_what_is_close():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    points = np.concatenate([seeds, *[seeds ^ (np.uint64(1) << rng.integers(0, 64, (40, 2)).astype(np.uint64)) for _ in range(4)]])
    cells = np.zeros((len(points), 2), np.int64)

    def groups(pairs):
        of = {i: {i} for i in range(len(points))}
        for a, b in pairs:
            if of[a] is not of[b]:
                of[a] |= of[b]
                for i in of[b]:
                    of[i] = of[a]
        return {frozenset(g) for g in of.values()}

    whole = N.close_pairs(cells, points, 12, small=1000)
    tree = N.close_pairs(cells, points, 12, small=16)
    brute = [(i, j) for i in range(len(points)) for j in range(i) 
             if sum((int(x) ^ int(y)).bit_count() for x, y in zip(points[i], points[j])) <= 12]
    assert {(max(p), min(p)) for p in zip(*map(np.ndarray.tolist, whole))} == set(brute)
    assert groups(zip(*map(np.ndarray.tolist, tree))) == groups(brute)
    assert len(tree[0]) < (1 + N.HUBS) * len(points)


def test_rounds_change_no_group(spark):
    """Pairs left out because they are connected: same groups as with one round, fewer comparisons."""
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(100 * g + i, " ".join(edited(rng, base, 0.02 * (i % 12) + 0.01))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    nodes = (docs.select("doc_id", N.F.lit(0).cast("long").alias("tag"), "text").mapInArrow(N._nodes(5), N._NODES)
             .drop("doc_id", "tag").dropDuplicates(["node"]))
    nodes = N.materialise(nodes, "nodes")
    one, several = (sorted(map(tuple, N.near_groups(nodes, rounds=r).select("node", "root").collect())) for r in ((), (6, 12, 20)))
    assert one == several and one
    pairs = N.candidates(nodes)
    groups = N.near_groups(nodes, bits=12)
    root = dict(map(tuple, groups.select("node", "root").collect()))
    left = {tuple(r) for r in N.between_groups(pairs, groups).collect()}
    assert left == {(r.a, r.b) for r in pairs.collect() if root.get(r.a, r.a) != root.get(r.b, r.b)}
    assert len(left) < pairs.count()


def test_no_link_is_lost(spark):
    """Short texts at the threshold, whose fingerprints may be far apart: every link counts, and none below it."""
    rng = random.Random(7)
    rows = []
    for g in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(8)]  # four shingles
        rows += [(10 * g, words), (10 * g + 1, words + ["x"]), (10 * g + 2, words + ["q", "r"])]  # five, six
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(6)
    kept = {r.doc_id for r in N.first_of_near_copies(docs).collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1}


def test_exact_search_alone(spark):
    """Without any SimHash group, and with split buckets, the rare shingles alone give the groups of a brute-force search."""
    from logfault.llm import rare_shingles as R
    rng = random.Random(3)
    common = [f"c{rng.randrange(10**6)}" for _ in range(60)]
    texts = {}
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 300))]
        texts |= {100 * g + i: " ".join(edited(rng, base, 0.03 * (i % 9))) for i in range(30)}
        texts |= {100 * g + 50 + i: " ".join(edited(rng, base, 0.1) + common) for i in range(10)}
    group, links = brute_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "0L AS tag", "text")
    prints = N.materialise(docs.mapInArrow(N._nodes(5), N._NODES), "prints")
    nodes = N.materialise(prints.drop("doc_id", "tag").dropDuplicates(["node"]), "nodes")
    alone = spark.createDataFrame([], "node long, root long")
    left = R.survivors(nodes, 0.8)
    pairs = R.open_pairs(R.rare_first(left, 0.8), R.marks_of(left), alone, 0.8, False, cell=8)
    found = {frozenset(p) for p in N.alike(pairs, nodes).toLocalIterator()}
    node_of = {shingles(texts[r.doc_id]): r.node for r in prints.select("doc_id", "node").collect()}
    assert found == {frozenset((node_of[a], node_of[b])) for a, b in links} and len(links) > 100


def test_odd_rows(spark):
    rows = [(3, "a b c", "x"), (1, "A\tB  c", "y"), (2, None, "z"), (4, "", "z"), (5, " \n", "z"), (None, "a b c", "n"), (None, "alone here", "n"),
            (None, "alone here", "n"), (6, "word " * 200_000, "l"), (7, "word " * 200_001, "l"), (8, "a b d", "x"), (8, "a b d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").selectExpr("*", "_key AS node", "_key AS `tag.x`", "1 AS grams")
    got = N.first_of_near_copies(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted(((r.doc_id or 0, r.text and r.text[:10], r.node) for r in got.collect()), key=str) == sorted(
        [(1, "A\tB  c", "y"), (2, None, "z"), (0, "alone here", "n"), (6, "word word ", "l"), (8, "a b d", "x")], key=str)
    assert N.first_of_near_copies(docs.limit(0)).count() == 0
