"""Bins, shares, weights and white space at their edges."""

from pyspark.sql import functions as F

from logfault.functions import cleaning as C, measures as M
from logfault.learning.weights import attach_weights
from logfault.operators.profiles import value_mix


def test_bins_of_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "x double, c double")
    edges = df.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("c").alias("p"), F.max("c").alias("q"))
    rows = df.crossJoin(F.broadcast(edges)).select(M.equal_width_bin("x", "a", "b").alias("x"), M.equal_width_bin("c", "p", "q").alias("c"))
    assert [(r.x, r.c) for r in rows.collect()] == [(0, 4), (9, 4), (None, 4)]
    none = spark.createDataFrame([(None,)], "x double")
    assert none.select(M.equal_width_bin("x", None, None).alias("x")).first().x is None


def test_unicode_white_space(spark):
    df = spark.createDataFrame([(" A　b c d ",)], "t string")
    row = df.select(C.words("t").alias("w"), C.trim_lower("t").alias("l")).first()
    assert row.w == ["A", "b", "c", "d"] == (" A　b c d ".split())
    assert row.l == "a　b c d"


def test_weights_of_training_rows_only(spark):
    df = spark.createDataFrame([(0, False)] * 3 + [(1, False)] + [(1, True)] * 4, "y int, held_out boolean")
    got = {r.y: r.weight for r in attach_weights(df, "y", counted=df.filter("NOT held_out")).distinct().collect()}
    assert abs(got[0] - 4 / 6) < 1e-9 and abs(got[1] - 2.0) < 1e-9


def test_value_mix(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert {(r.v, r.n, r.share) for r in value_mix(df, "v").collect()} == {("a", 2, 0.5), ("b", 1, 0.25), (None, 1, 0.25)}
    assert not [n for n in value_mix(df, "v")._jdf.queryExecution().executedPlan().toString().split() if n == "Window"]


def test_rounded_is_round(spark):
    import random
    from logfault.functions.measures import rounded
    rng = random.Random(7)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), 1e300, -1e-9, 0.1234565, 0.0000005, -0.0000005, 0.9999995, 2.5e-7, 123456789.1234565]
    values += [rng.random() for _ in range(2000)] + [round(rng.uniform(-2, 2), 6) + 5e-7 for _ in range(2000)] + [rng.randint(0, 2 ** 24) / 2 ** 24 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    from pyspark.sql import functions as F
    assert df.filter(~rounded("v", 6).eqNullSafe(F.round("v", 6))).count() == 0
