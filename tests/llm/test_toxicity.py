"""The toxicity model: features, learning, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logfault.llm import toxicity as T


def test_features_are_those_of_the_words(monkeypatch):
    whole = T.features("One two three four two. ONE")
    assert whole[0] == 0 and len(set(whole.tolist())) == len(whole)
    assert np.array_equal(whole, T.features("one TWO three, four two one"))
    long = " ".join(f"w{i % 50}" for i in range(1000))
    want = T.features(long)
    monkeypatch.setattr(T, "_CHUNK", 64)
    assert np.array_equal(T.features(long), want)
    assert T.features("").tolist() == [0]


def test_score_is_the_sum_over_features():
    rng = np.random.default_rng(1)
    dense = np.where(rng.random(1 << T.BITS) < 0.3, rng.normal(size=1 << T.BITS), 0)
    text = "a quick brown fox and a quick brown dog " * 20
    assert T.score_of(text, dense) == pytest.approx(T.probability(dense[T.features(text)].sum()))


def test_weights_are_sparse():
    rng, model = random.Random(1), T.Ftrl()
    for _ in range(400):
        label = rng.randint(0, 1)
        words = [f"w{rng.randint(0, 500)}" for _ in range(20)] + (["scum"] if label else [])
        model.learn(T.features(" ".join(words)), label)
    at, w = model.model()
    assert len(at) < 600 and np.isfinite(w).all()
    dense = np.zeros(1 << T.BITS)
    dense[at] = w
    assert T.score_of("w1 w2 w3 scum", dense) > 0.5 > T.score_of("w1 w2 w3", dense)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = T.scored(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.toxic == t] for t in (0, 1))
    assert np.mean([np.mean(np.array(good) < s) for s in bad]) > 0.95
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.02 * len(good)


def test_does_not_depend_on_partitions_or_held_out_labels(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    one = T.train(docs.repartition(1), labels)
    flipped = labels.withColumn("toxic", F.when(T.remainder("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    two = T.train(docs.repartition(9), flipped.repartition(4))
    assert np.array_equal(one[0], two[0]) and np.allclose(one[1], two[1])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad scum", "x"), (1, "bad scum", "x"), (2, None, "y"), (None, "fine", "z"), (3, "", "w")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = T.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert T.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in T.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert T.without_toxic(docs, labels).columns == docs.columns
