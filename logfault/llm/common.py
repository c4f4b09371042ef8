"""Helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in join keys.
NO_ID = -(1 << 63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key`` (the id, never null), ``tag`` (a hash of the text) and ``text``.

    Rows with one id but different texts get different (key, tag) pairs, so
    repeated ids cannot mix; rows equal in both are the same text anyway.
    """
    text = text_of(text_col)
    return df.select(row_key(id_col).alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))


def row_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def id_of(key: str = "key") -> Column:
    """The id that :func:`keyed` has put into ``key``."""
    return F.when(F.col(key) != NO_ID, F.col(key))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]
