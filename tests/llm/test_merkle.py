"""The manifest against plain trees; damage is seen."""

import hashlib

import pytest
from pyspark.sql import functions as F

from logfault.llm import merkle

FIELDS = ("doc_id", "source", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root of a list of digests and each one's siblings per level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, o in zip(paths, own):
            start = o // 3 * 3
            path.append(("".join(nodes[start:o]), "".join(nodes[o + 1:start + 3])))
        nodes = [sha(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        own = [o // 3 for o in own]
    return nodes[0], paths


def brute(rows):
    """(leaf, subroot, root, path) of every row, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        leaves = sorted(((r[0] is not None, r[0] or 0, leaf_of(r)) for r in groups[g]))
        trees[g] = [x[2] for x in leaves], climb([x[2] for x in leaves])
    root, above = climb([trees[g][1][0] for g in order])
    return sorted((leaf, sub, root, path + up) for g, up in zip(order, above)
                  for leaves, (sub, paths) in [trees[g]] for leaf, path in zip(leaves, paths))


def made(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, grp int, rank int, path int")
    return merkle.manifest(df.repartition(5), FIELDS)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 9, 10), (27, 28, 731, 1, 2200)])
def test_equals_plain_trees(spark, sizes):
    rows = [(i, f"s{g}", f"text {i} ü\n") for g, n in enumerate(sizes) for i in range(g, n * 7 + g, 7)]
    found = made(spark, rows).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in found) == brute(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a", "x"), (None, "a", None), (1, None, ""), (2, None, "y"), (2, None, "y"), (2, "a", "z"), (3, "", None)]
    found = merkle.verified(made(spark, rows), "leaf").collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in found) == brute(rows)
    assert all(r["verified"] for r in found)
    assert made(spark, rows).columns == ["doc_id", "source", "rank", "leaf", "subroot", "root", "path"]
    assert made(spark, rows[:0] or [rows[0]]).filter("false").count() == 0
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert merkle.manifest(empty, FIELDS).count() == 0


def test_a_changed_text_is_seen(spark):
    rows = [(i, "a" if i % 3 else None, "line\n" * (i % 5)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    cut = merkle.digest(merkle.field("doc_id"), merkle.field("source"), merkle.marked(F.replace("text", F.lit("\n"), F.lit(""))))
    found = merkle.verified(merkle.manifest(df, FIELDS, payload={"seen": cut}), "seen").collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {i for i, _, t in rows if t}


def test_intervals(spark):
    """Each node covers its children, a level covers all leaves once, and digests follow from the level below."""
    df = spark.createDataFrame([(i, "a", "t") for i in range(1000)], "doc_id long, source string, text string")
    leaves = df.select(F.col("source").alias("grp"), merkle.digest(merkle.field("doc_id")).alias("digest"), F.col("doc_id").alias("payload"))
    tree = merkle.Tree(merkle.ranked(leaves, [F.col("payload")]))
    levels = {}
    for r in tree.nodes().collect():
        levels.setdefault(r["level"], []).append((r["lo"], r["hi"], r["digest"]))
    assert sorted(levels) == list(range(8))
    for level, nodes in levels.items():
        nodes.sort()
        assert [n[0] for n in nodes] == list(range(0, 1000, 3 ** level)) and nodes[-1][1] == 1000
        if level:
            below = sorted(levels[level - 1])
            assert [n[2] for n in nodes] == [sha(*(b[2] for b in below[i:i + 3])) for i in range(0, len(below), 3)]
    assert levels[7][0][2] == tree.roots().first()["digest"]


def test_long_text(spark):
    rows = [(1, "a", "x" * 3_000_000), (2, "a", "ü" * 1_000_000)]
    assert sorted(r["leaf"] for r in made(spark, rows).collect()) == sorted(map(leaf_of, rows))
