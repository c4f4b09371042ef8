"""SimHash fingerprints and groups against brute force."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from logfault.llm import simhash
from logfault.llm.components import components


def brute_print(text, width=4):
    words = [w.encode() for w in "".join(c.lower() if c.isascii() else c for c in text)
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(points, bits):
    left, roots = set(points), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            p = todo.pop()
            group.add(p)
            near = {q for q in left if (p ^ q).bit_count() <= bits}
            left -= near
            todo += near
        for p in group:
            roots[p] = frozenset(group)
    return roots


@pytest.mark.parametrize("text", ["", " \n", "One", "one Two", "ÄÖ É é A\x85b　c d e f g", "a b c d\te f\x0bg h a b c d " * 30])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def cluster(rng, size, spread):
    seeds = [rng.getrandbits(64) for _ in range(size)]
    out = list(seeds)
    for s in seeds:
        p = s
        for _ in range(spread):
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
            out.append(p)
    return out


@pytest.mark.parametrize("cell", [4096, 8])
def test_groups_of_points(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "PROBE", 1)
    rng = random.Random(cell)
    points = set(cluster(rng, 40, 6)) | {0, (1 << 64) - 1}
    base = rng.getrandbits(64)
    points |= {base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i, 12)}  # a crowded cell
    rows = [(simhash._signed(p),) for p in points]
    edges = simhash.links(spark.createDataFrame(rows, "point long").repartition(5), 4, cell)
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    want = brute_groups(points, 4)
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(edges).collect()}
    assert {p: roots.get(p, p) for p in points} == {p: (min(want[p], key=simhash._signed)) for p in points}


def test_every_close_pair_shares_a_cell(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        p = q = rng.getrandbits(64)
        for b in rng.sample(range(64), 4):
            q ^= 1 << b
        rows.append((i, simhash._signed(p), simhash._signed(q)))
    df = spark.createDataFrame(rows, "i int, p long, q long")
    df = df.withColumns({c: simhash.count_pairs(c) for c in "pq"})
    assert df.filter(~F.arrays_overlap(simhash.cell_keys("p", 4), simhash.cell_keys("q", 4))).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (3, 4), (200, 100)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


def texts():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows = [(i, prose(80)) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)] + [(200, rows[7][1]), (-5, rows[7][1])]
    return rows + [(300, None), (301, ""), (302, "\n"), (None, rows[8][1]), (None, "all alone here now then"), (9, rows[9][1])]


def test_documents(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, point string").repartition(6)
    prints = [brute_print(t or "") for _, t in rows]
    groups = brute_groups(prints, 4)
    ids = {g: min((i for (i, _), p in zip(rows, prints) if p in g and i is not None), default=None) for g in set(groups.values())}
    want = Counter((i, f"{p:016x}", ids[groups[p]]) for (i, _), p in zip(rows, prints))
    got = simhash.near_groups(df).select("doc_id", simhash.hex_of("point").alias("f"), "component_id").collect()
    assert Counter(tuple(r) for r in got) == want
    kept = simhash.first_of_groups(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(v) for v in ids.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(df).count() == 0
    assert simhash.first_of_groups(df).count() == 0


def test_columns_of_the_user_stay(spark):
    """Whatever their names, also those that the operators use inside."""
    from logfault.llm.secrets import without_secrets
    names = ["_own", "_text", "_key", "_tag", "_blob", "_hit", "own", "rest", "blob", "hit", "key", "point", "a.b"]
    rows = [(i, f"text number {i % 3} password=abcdefgh{i % 3}", *[f"{n}{i}" for n in names]) for i in range(6)] + [(None, None, *names), (9, "", *names)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    kept = simhash.first_of_groups(df)
    assert kept.columns == df.columns
    by_row = {tuple(r[2:]): r for r in map(tuple, rows)}
    got = [tuple(r) for r in kept.collect()]
    assert got and all(by_row[r[2:]] == r for r in got)
    clean = without_secrets(df)
    assert clean.columns == df.columns
    got = {tuple(r)[2:]: tuple(r)[:2] for r in clean.filter("doc_id < 6").collect()}
    assert got == {r[2:]: (r[0], f"text number {r[0] % 3} [REDACTED]") for r in map(tuple, rows[:6])}
    assert without_secrets(df.filter("false")).count() == 0 == simhash.first_of_groups(df.filter("false")).count()
    assert without_secrets(df.select("text")).count() == len(rows)
