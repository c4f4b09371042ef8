"""Cross-validation folds, the same on every run and every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import dense_order, sliced_rank

SEED = 42


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 10, seed: int = SEED,
                     out: str = "fold") -> DataFrame:
    """Deal the rows of each label to ``k`` folds in the order of a keyed hash.

    Ranks are taken per leading hash digits, so a label that holds most rows
    is not one task.
    """
    df = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))))
    ranked = sliced_rank(df, [label], {"_lead": F.substring("_hash", 1, 3)}, ["_hash", key], "_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_hash", "_rank")


def group_folds(df: DataFrame, group: str, k: int = 10, out: str = "fold") -> DataFrame:
    """Whole groups per fold: by size (ties: by name), dealt in snake order."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = dense_order(sizes, [F.col("_n").desc(), F.col(group)], "_rank")
    turn, place = F.floor((F.col("_rank") - 1) / k), (F.col("_rank") - 1) % k
    fold = F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int")
    return df.join(ranked.select(group, fold.alias(out)), group, "left")
