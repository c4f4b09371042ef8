"""Repeated passages against brute force."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from logfault.llm import repeats, suffix_dedup  # noqa: E402
from logfault.llm.suffix_dedup import remove_repeats, without_repeats  # noqa: E402


def brute(texts, length, keep_first):
    """(id, removed bytes, spans, hash of the rest) by counting every window."""
    seen, counts = set(), Counter()
    for _, t in texts:
        counts.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            if (w in seen) if keep_first else counts[w] > 1:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3, passages=4, texts=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(passages)]
    out = []
    for i in range(texts):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 80)
            parts += [p[a:a + rng.randint(20, 300)], prose(rng.randint(0, 20))]
        out.append((i, " ".join(parts)))
    out += [(100, out[3][1]), (101, "aaaa" * 200), (102, ""), (103, "ab" * 150), (104, out[5][1][1:])]
    return out


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("limit", [4000, 1])
def test_against_brute_force(spark, monkeypatch, keep_first, limit):
    if limit == 1:
        monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 1_000_000)  # every class of two or more is hot
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: tuple(r)[:5] for r in remove_repeats(df, length=100, keep_first=keep_first, limit=limit).collect()}
    want = {r[0]: r for r in brute([(i, t.encode()) for i, t in rows], 100, keep_first)}
    assert got == want


def test_pieces_meet_without_a_gap(monkeypatch):
    text = random.Random(5).randbytes(5000)
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = repeats.anchors(text, 100)
    assert [s for lo, hi, _, _ in cut for s in range(lo, hi + 1)] == list(range(len(text) - 99))


def test_suffix_order_is_byte_order():
    data = np.frombuffer(random.Random(1).randbytes(3000).replace(b"\x07", b"\0"), np.uint8) % 3
    data = data.astype(np.uint8)
    starts = np.arange(len(data) - 40 + 1)
    order, same = repeats.suffix_order(data, starts, 40)
    raw = data.tobytes()
    assert order.tolist() == sorted(starts.tolist(), key=lambda i: (raw[i:i + 40], i))
    assert all(s == (raw[a:a + 40] == raw[b:b + 40]) for a, b, s in zip(order[1:], order, same[1:]))


def test_nulls_repeats_and_clashes(spark):
    passage = "x".join(str(i) for i in range(100))
    rows = [(1, passage, "a"), (1, passage, "a"), (None, passage, None), (2, None, "b"), (3, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    every = {(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(df, length=100, keep_first=False).collect()}
    n = len(passage)
    assert every == {(1, n, n), (None, n, n), (2, 0, 0), (3, 0, 0)}
    first = without_repeats(df, chars_col=None, length=100)
    assert first.columns == df.columns
    # A null id sorts first, so its text is the copy that stays; repeated rows are one text.
    assert Counter(tuple(r) for r in first.collect()) == Counter(
        [(1, "", "a"), (1, "", "a"), (None, passage, None), (2, None, "b"), (3, "", "c")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert remove_repeats(df).count() == 0
    assert without_repeats(df).count() == 0


def test_stage_keeps_columns_and_first_copy(spark):
    rows = [(i, t, len(t), "s") for i, t in corpus(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, source string")
    out = without_repeats(df, length=100)
    assert out.schema == df.schema
    want = {r[0]: r for r in brute([(i, t.encode()) for i, t, *_ in rows], 100, True)}
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        if not want[i][2]:
            assert got[i].text == t
        assert got[i].n_chars == len(got[i].text)
    assert out.filter(F.col("text").isNull()).count() == 0


def brute_words(texts, length):
    """The words that stay if every window of words but its first copy goes."""
    seen, out = set(), {}
    for key, t in texts:
        words = t.split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i:i + length])
            if w in seen:
                gone[i:i + length] = [True] * length
            seen.add(w)
        out[key] = [w for w, g in zip(words, gone) if not g]
    return out


@pytest.mark.parametrize("limit", [4000, 1])
def test_passages_of_over_50_words(spark, limit):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, at = [], 0
    for size in (49, 50, *range(51, 66), 80):
        passage = prose(size)
        for near in (prose(9), prose(30), passage[:40]):
            at += 1
            rows.append((at, f"{near} {passage}\n{prose(20)}"))
    short = " ".join(rng.choice("abcdefg") for _ in range(51))  # 101 bytes
    rows += [(200, f"x {short} y"), (201, f"y {short.replace(' ', chr(10))}"), (202, ""), (203, " \n")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(7)
    got = {r.doc_id: r for r in without_repeats(df, length=4000, limit=limit, words=51).collect()}
    want = brute_words(rows, 51)
    assert {i: r.text.split() for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert want[201] == ["y"] and sum(len(want[i]) < len(t.split()) for i, t in rows) >= 32
    docs = df.filter("doc_id < 200")
    staged = {r.doc_id: r.text.split() for r in corpus_pipeline.suffix_dedup_stage(spark, docs, "").collect()}
    assert all(len(staged[i]) <= len(want[i]) for i in staged)


@pytest.mark.parametrize("limit", [4000, 1])
def test_repeated_rows_keep_what_they_share(spark, limit):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    passage = prose(60)
    once = [(1, f"{prose(30)} {passage} {prose(30)}"), (2, f"{prose(30)} {passage} {prose(30)}")]
    df = spark.createDataFrame([*once, once[0], once[0]], "doc_id long, text string").repartition(3)
    want = {r[0]: r for r in brute([(i, t.encode()) for i, t in once], 100, True)}
    got = [tuple(r)[:5] for r in remove_repeats(df, length=100, limit=limit).collect()]
    assert Counter(got) == Counter([want[1]] * 3 + [want[2]])
    kept = {(r.doc_id, r.text) for r in without_repeats(df, chars_col=None, length=4000, limit=limit, words=51).collect()}
    assert (1, once[0][1]) in kept and len(kept) == 2 and (2, once[1][1]) not in kept
