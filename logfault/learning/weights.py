"""Class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, weight`` with weight = rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select(
        label, "n", (F.col("_rows") / (F.col("_classes") * F.col("n"))).alias("weight"))


def attach_weights(df: DataFrame, label: str = "label", out: str = "weight",
                   counted: DataFrame | None = None) -> DataFrame:
    """Add the balanced weight of the classes of ``counted`` (by default of ``df``).

    There is one row per class to broadcast; a class that is not counted
    weighs 1.
    """
    weights = class_weights(df if counted is None else counted, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label, "left").withColumn(out, F.coalesce(out, F.lit(1.0)))
