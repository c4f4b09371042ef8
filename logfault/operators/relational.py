"""Small table operators: nulls, fold tables, confusion of keys."""

from __future__ import annotations

from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame, functions as F


def fill_text(df: DataFrame, value: str = "MISSING", columns=None) -> DataFrame:
    """Fill nulls of string columns only."""
    text = [name for name, kind in df.dtypes if kind == "string"]
    return df.fillna(value, [c for c in text if columns is None or c in columns])


def mean_impute(train: DataFrame, test: DataFrame, columns: list[str], fit_on: str = "each"):
    """Fill numeric nulls with the column mean.

    ``fit_on='each'`` gives every table its own means; ``'train'`` uses the
    training means for both.
    """
    imputer = Imputer(strategy="mean", inputCols=columns, outputCols=columns)
    model = imputer.fit(train)
    other = model if fit_on == "train" else imputer.fit(test)
    return model.transform(train), other.transform(test)


def keyed_append(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Glue the columns of two tables row by row, matched by key."""
    return left.join(right, keys, "inner")


def join_folds(importance: DataFrame, n_folds: int) -> DataFrame:
    """Features present in every fold with their summed importance.

    One aggregate over the long form in place of a chain of joins.
    """
    return (importance.groupBy("feature")
            .agg(F.sum("importance").alias("importance"), F.count_distinct("fold").alias("_folds"))
            .filter(F.col("_folds") == n_folds).drop("_folds"))


def drop_lowest(importance: DataFrame, lowest: int) -> DataFrame:
    """Features without the ``lowest`` least important ones (ties by name).

    The few rows to drop are found by a top-k and removed by an anti join.
    """
    worst = importance.orderBy("importance", "feature").limit(lowest).select("feature")
    return importance.join(worst, "feature", "left_anti")
