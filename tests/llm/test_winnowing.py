"""Winnowing against a plain implementation on the same gram hashes, and the next-document join."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logfault.llm import winnowing as W

TOKEN = re.compile("[぀-ヿ㐀-鿿]|[^\x20\x09-\x0D぀-ヿ㐀-鿿]+")


def brute(tokens, gram=W.GRAM, window=W.WINDOW):
    """Places kept, given any hash per gram."""
    grams = [tuple(tokens[i:i + gram]) for i in range(max(len(tokens) - gram + 1, 1 if tokens else 0))]
    return grams, window


def texts():
    rng = random.Random(4)
    words = ["a", "b", "cc", "é", "日本語", "x", "😀", "\n", "\t"]
    return [" ".join(rng.choice(words[:rng.randint(1, 9)]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["", None, " \n", "a " * 500]


def test_windows(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, t string").withColumn("t", F.coalesce("t", F.lit("")))
    every = W.fingerprint(F.col("t"), W.GRAM, 1)  # each gram is its own window
    out = df.select("t", F.transform(every, W.hash_of).alias("all"), F.transform(W.fingerprint(F.col("t")), W.hash_of).alias("h"),
                    F.transform(W.fingerprint(F.col("t")), W.place_of).alias("p")).collect()
    seen = {}
    for r in out:
        tokens = TOKEN.findall(r.t)
        grams, window = brute(tokens)
        assert len(r.all) == len(grams)
        for g, h in zip(grams, r.all):
            assert seen.setdefault(g, h) == h  # the hash is a function of the gram
        want = []
        for i in range(max(len(grams) - window + 1, 1 if grams else 0)):
            part = r.all[i:i + window]
            at = i + max(j for j, h in enumerate(part) if h == min(part))
            if at not in want:
                want.append(at)
        assert r.p == want and r.h == [r.all[i] for i in want]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("bucket", [256, 2])
def test_next_text(spark, bucket):
    rng = random.Random(bucket)
    ids = rng.sample(range(-50, 3000), 60) + [10**15 + i for i in range(5)] + [None]
    rows = [(i, None if i == ids[3] else f"text {i}", "c") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, cell string").repartition(5)
    got = {r.doc_id: (r.text, r.next_text) for r in W.with_next(df, bucket=bucket).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == {r[0]: (r[1] or "", n[1] or "") for r, n in zip(order, order[1:] + order[:1])}


def test_one_row_repeats_and_empty(spark):
    one = spark.createDataFrame([(5, "ab cd ef")], "doc_id long, text string")
    assert [tuple(r) for r in W.with_next(one).collect()] == [(5, "ab cd ef", "ab cd ef")]
    same = spark.createDataFrame([(5, "ab")] * 3 + [(6, "x")], "doc_id long, text string")
    assert sorted(r.next_text for r in W.with_next(same).collect()) == ["ab", "ab", "ab", "x"]
    assert W.with_next(one.limit(0)).count() == 0
    assert W.compared(one.limit(0)).count() == 0


def test_compared_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in W.compared(docs).collect()}
    assert len(got) == len(rows)
    for r, n in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        new = r.text[:len(r.text) - half] + n.text[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        shared = len(TOKEN.findall(r.text[:len(r.text) - half])) - 1
        if shared >= W.GRAM + W.WINDOW - 1:
            assert g.near_edited > 0  # the match guarantee
        if n.text == r.text:
            assert g.near_next == 1
    assert sum(g.near_edited for g in got.values()) > 2 * sum(g.near_next for g in got.values())
