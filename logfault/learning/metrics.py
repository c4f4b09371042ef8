"""Scores from confusion counts. ``truth`` and ``guess`` hold class numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Weight of each class in the contest's score.
CLASS_WEIGHTS = (5 / 11, 4 / 11, 1 / 11, 1 / 11)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, truth: str = "label", guess: str = "guess") -> DataFrame:
    """``class, precision, recall, f1, support`` for every class seen; a ratio
    with an empty denominator is 0."""
    counts = confusion(df, truth, guess)
    right = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    sides = (counts.select(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).alias("claimed"),
                           right.alias("hit"))
             .unionByName(counts.select(F.col("guess").alias("class"), F.lit(0).alias("support"),
                                        F.col("n").alias("claimed"), F.lit(0).alias("hit"))))
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hit")])

    def share(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    rated = sums.withColumn("precision", share("hit", "claimed")).withColumn("recall", share("hit", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return rated.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")


def weighted_f1(df: DataFrame, truth: str = "label", guess: str = "guess", weights=CLASS_WEIGHTS) -> DataFrame:
    """One row ``score``: F1 of each class times its weight."""
    weight = F.coalesce(F.get(F.array(*[F.lit(w) for w in weights]), F.col("class").cast("int")), F.lit(0.0))
    return per_class(df, truth, guess).agg(F.sum(weight * F.col("f1")).alias("score"))


def macro_f1(df: DataFrame, truth: str = "label", guess: str = "guess") -> DataFrame:
    return per_class(df, truth, guess).agg(F.avg("f1").alias("score"))


def report(df: DataFrame, truth: str = "label", guess: str = "guess") -> DataFrame:
    """Per-class rows, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    classes = per_class(df, truth, guess)
    total = F.sum("support")

    def averaged(name, how):
        return classes.agg(*[how(c).alias(c) for c in ("precision", "recall", "f1")],
                           total.alias("support")).withColumn("class", F.lit(name))

    accuracy = F.sum(F.col("recall") * F.col("support")) / total
    rows = [classes.withColumn("class", F.col("class").cast("string")),
            classes.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"),
                        total.alias("support")).withColumn("class", F.lit("accuracy")),
            averaged("macro avg", F.avg),
            averaged("weighted avg", lambda c: F.sum(F.col(c) * F.col("support")) / total)]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
