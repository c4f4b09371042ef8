"""Ball-tree search against plain scoring of every document."""

import math
import random
import re

import numpy as np
import pytest

from logfault.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    words = [(key, terms(t)) for key, t in docs]
    n = sum(1 for _, w in words if w)
    total = sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for key, w in words:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * w.count(t)) // (1000 * w.count(t) + 20 * (50 + (50 * len(w) * n) // total)))
                        for t in set(terms(text)) if t in df and t in w)
            if score > 0:
                scored.append((-score, key is not None, key))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, key, -score) for i, (score, _, key) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, parts=4, **options):
    d = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, n int, score int").repartition(parts)
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, q int")
    rows = lexical.ranked_search(d, i, **options).select("item_id", "rank", "doc_id", "score").collect()
    return sorted(map(tuple, rows), key=repr)


def corpus(seed, size, words=60):
    rng = random.Random(seed)
    names = [f"{'Wörd' if i % 7 else 'word'}{i}" for i in range(words)]
    return [(i, " ".join(rng.choices(names, [1 / (j + 1) for j in range(words)], k=rng.randint(0, 40)))) for i in range(size)], rng, names


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_scoring(spark, seed):
    docs, rng, names = corpus(seed, 300)
    items = [(i, " ".join(rng.sample(names, rng.randint(1, 9)))) for i in range(8)]
    assert found(spark, docs, items, chunk=64, leaf=4, top=7) == brute(docs, items, 7)


def test_ties_copies_and_repeats(spark):
    docs = [(i, "same words here") for i in range(400)] + [(7, "same words here"), (None, "same"), (None, None), (900, ""), (901, "!?")]
    items = [(1, "same words"), (1, "same words"), (1, "here"), (2, None), (3, "absent"), (4, "?"), (None, "WORDS same")]
    assert found(spark, docs, items, chunk=50, leaf=8) == brute(docs, items)


def test_batches_give_equal_rows(spark):
    docs, rng, names = corpus(9, 200)
    items = [(i, " ".join(rng.sample(names, 4))) for i in range(12)]
    assert found(spark, docs, items, batch_bytes=60) == found(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_long_texts(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b")], []) == []
    docs = [(1, "needle " + "hay " * 500_000), (2, "needle"), (3, "x" * 2_000_000)]
    assert found(spark, docs, [(1, "Needle hay")]) == brute(docs, [(1, "Needle hay")])


def test_subtrees_are_pruned():
    """Topics apart: a query about one topic leaves most leaves unseen."""
    rng = np.random.default_rng(0)
    ids, starts = [], [0]
    for i in range(4096):
        ids.append(np.sort(rng.choice(50, 12, replace=False)) + 50 * (i % 16))
        starts.append(starts[-1] + 12)
    rows = lexical.Rows(np.arange(4096), np.array(starts), np.concatenate(ids), np.full(starts[-1], 1000, np.int64))
    weights = rng.integers(1, 5000, 800)
    tree = lexical.Tree(rows, np.sqrt(weights.astype(float)), 64)
    query = np.sort(rng.choice(50, 8, replace=False)) + 100
    bounds = tree.bounds(np.array([0, 8]), query, np.sqrt(weights[query].astype(float)))
    dense = np.zeros(800, np.int64)
    dense[query] = weights[query]
    best = []
    seen = lexical.search(tree, bounds[:, 0], dense, best, 50)
    scores = rows.dot(dense)
    assert sorted((-s, -k) for s, k in best) == sorted(zip((-scores).tolist(), range(4096)))[:50]
    leaves = sum(c is None for c in tree.children)
    assert seen <= leaves / 4
    # No document below a node beats the node's bound.
    def keys(node):
        return tree.rows[node].keys.tolist() if tree.children[node] is None else [k for c in tree.children[node] for k in keys(c)]
    assert all(scores[keys(node)].max() <= bounds[node, 0] for node in range(len(tree.radius)))
