import pytest
from pyspark.sql import functions as F

from logfault.learning import folds, metrics, oversample as OS, two_stage as TS, weights
from logfault.operators.ranking import dense_order, sliced_rank


def test_scores(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 2, 3], [0, 1, 1, 2, 2])), "label int, guess int")
    assert metrics.weighted_f1(df).first()[0] == pytest.approx(0.606061, abs=1e-6)
    assert metrics.macro_f1(df).first()[0] == pytest.approx(0.5)
    rows = {r["class"]: r for r in metrics.report(df).collect()}
    assert rows["accuracy"]["f1"] == pytest.approx(0.6)
    assert rows["3"]["f1"] == 0 and rows["3"]["support"] == 1
    absent = spark.createDataFrame([(0, 0), (0, 3)], "label int, guess int")
    assert metrics.weighted_f1(absent).first()[0] == pytest.approx(5 / 11 * 2 / 3)


def test_folds(spark):
    df = spark.range(1003).select(F.col("id").alias("key"), F.when(F.col("id") % 10 < 7, 0).otherwise(1).alias("label"),
                                  F.concat(F.lit("g"), F.floor(F.sqrt("id"))).alias("sn"))
    a = folds.stratified_folds(df.repartition(1), "label", "key", 10)
    b = folds.stratified_folds(df.repartition(7), "label", "key", 10)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == 1003
    spread = a.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in spread)
    groups = folds.group_folds(df, "sn", 5)
    assert groups.count() == 1003
    assert groups.groupBy("sn").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert groups.select("fold").distinct().count() == 5


def test_ranks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 500).alias("v"))
    got = sliced_rank(df, ["k"], {"_s": F.floor(F.col("v") / 20)}, ["v"], "r")
    rows = sorted((r["k"], r["v"], r["r"]) for r in got.collect())
    for k in range(3):
        assert [r for kk, _, r in rows if kk == k] == list(range(1, sum(1 for x in rows if x[0] == k) + 1))
    order = dense_order(df, ["k", "v"]).collect()
    assert [r["ordinal"] for r in sorted(order, key=lambda r: (r["k"], r["v"]))] == list(range(1, 501))


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert {r["label"]: r["weight"] for r in weights.class_weights(df).collect()} == {0: 8 / 12, 1: 8 / 4}


def test_oversample(spark, monkeypatch):
    monkeypatch.setattr(OS, "BLOCK_ROWS", 16)
    rows = [(i, 0 if i < 100 else 1 + i % 2, float(i % 17), float(i * i % 23), "ab"[i % 2]) for i in range(160)]
    df = spark.createDataFrame(rows, "key bigint, label int, x double, y double, t string")
    near = OS.neighbours(df, ["x", "y"], ["t"], cell_rows=8).collect()
    import statistics
    smallest = [r for r in rows if r[1] == 1]
    med = statistics.median([statistics.pstdev([r[2] for r in smallest]), statistics.pstdev([r[3] for r in smallest])])
    got = {}
    for r in near:
        got.setdefault(r["key"], []).append((r["rank"], r["distance"]))
    for key, label, x, y, t in rows[95:130]:
        want = sorted((a - x) ** 2 + (b - y) ** 2 + (med * med / 2 if u != t else 0)
                      for k, lab, a, b, u in rows if lab == label and k != key)[:5]
        assert [d for _, d in sorted(got[key])] == pytest.approx(want, abs=1e-6)
    made = OS.oversample(df, ["x", "y"], ["t"])
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {0: 100, 1: 100, 2: 100}
    low, high = made.agg(F.min("x"), F.max("x")).first()
    assert low >= 0 and high <= 16
    assert made.select("t").distinct().count() == 2


def test_two_stage(spark):
    rows = [(i, i % 4, float(i % 4) + (i % 7) / 100, f"m{i % 4}") for i in range(240)]
    df = spark.createDataFrame(rows, "fault_id bigint, label int, x double, m string")
    train = folds.stratified_folds(df, "label", "fault_id", 3)
    settings = TS.Settings(["x"], ["m"], trees=5, depth=3, rounds=3, stage_two_depth=2)
    held, test, importance = TS.cross_train(train, df.drop("label"), settings, ["fault_id"], 3)
    assert held.count() == 240 and held.select("fault_id").distinct().count() == 240
    sums = held.select((F.aggregate("p1", F.lit(0.0), lambda a, x: a + x)).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    right = held.filter(F.col("label") == F.col("guess")).count()
    assert right > 200
    assert test.count() == 240
    assert importance.select("fold").distinct().count() == 3


def test_one_encoding_for_few_and_many_categories(spark):
    from logfault.learning import two_stage as TS
    rows = [(i, f"v{i % 5}", f"w{i}", float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, few string, many string, x double")
    encoder = TS.Encoder(df, TS.Settings(["x"], ["few", "many"]))
    out = encoder.transform(df)
    field = out.schema["features"].metadata["ml_attr"]["attrs"]
    assert set(field) == {"numeric"} and len(field["numeric"]) == 3
    new = spark.createDataFrame([(1, "unseen", None, None)], "i int, few string, many string, x double")
    assert encoder.transform(new).count() == 1


def test_topics_and_clusters(spark, small):
    from pyspark.sql import functions as F
    from logfault.operators import documents as D, factors as X
    from logfault.sources import standin
    docs = standin.table(spark, small, "documents").select("doc_id", "text")
    vocab = D.vocabulary(D.term_counts(docs, ["doc_id"], "text", 1, 1), docs.count(), 5, 100)
    mixed = X.topic_mixture(X.tfidf_vectors(docs, vocab, high=1), k=3, max_iter=3)
    assert mixed.count() == docs.count()
    assert mixed.filter(F.size("topics") != 3).count() == 0
    points = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(20)], "i int, v array<double>")
    near = X.cluster_distances(points, "v", k=2).collect()
    assert len({r.cluster for r in near}) == 2
    assert all(min(r.cluster_dist_0, r.cluster_dist_1) < 1e-9 for r in near)


def test_neighbours_meet_few_cells(spark):
    """Exact neighbours with a third of all rows at one place, by far fewer comparisons than all pairs."""
    import numpy as np
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (40, 3))
    xyz = np.r_[centres[rng.integers(0, 40, 4000)] + rng.normal(0, 1, (4000, 3)), np.tile(centres[0], (2000, 1))]
    rows = [(int(i), 1, *map(float, v), "ab"[i % 2]) for i, v in enumerate(xyz)]
    df = spark.createDataFrame(rows, "key bigint, label int, x double, y double, z double, t string").repartition(5)
    penalty = OS.text_penalty(df, ["x", "y", "z"])
    got = {}
    for r in OS.neighbours(df, ["x", "y", "z"], ["t"], 4, cell_rows=64).collect():
        got.setdefault(r["key"], {})[r["rank"]] = r["near"]
    side = np.arange(len(xyz)) % 2
    for i in [*range(0, 4000, 97), 4000, 4001, 5999]:
        d = np.zeros(len(xyz))
        for c in range(3):
            d += (xyz[i, c] - xyz[:, c]) ** 2
        d += penalty * (side != side[i])
        d[i] = np.inf
        assert [got[i][n] for n in (1, 2, 3, 4)] == np.argsort(d, kind="stable")[:4].tolist()
    assert len(got) == 6000
    every = OS.points(df.select("key", "label", F.array("x", "y", "z").alias("numbers"), F.array(F.xxhash64("t")).alias("texts")), 4)
    assert every.count() == 4002
    pivots = OS.Pivots(every, 4, penalty, 64)
    cells = pivots.place(every)
    pivots.measure(cells)
    pairs = pivots.asking(cells).join(cells.groupBy(F.col("cell").alias("asked")).count(), "asked").agg(F.sum("count")).first()[0]
    assert pairs < 4002 ** 2 / 8
