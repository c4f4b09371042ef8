"""Left joins from a large table to a dictionary with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 10_000_000
MAX_HOT_KEYS = 1_000
SPREAD = 4_096


MAX_BROADCAST_ROWS = 1_000_000


def counted_broadcast(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``most`` rows.

    A larger table is returned as it is and joined by a shuffle, with equal
    results. Counting stops at the bound.
    """
    return df if df.limit(most + 1).offset(most).take(1) else F.broadcast(df)


def lookup(facts: DataFrame, dictionary: DataFrame, key: str, values: list[str],
           weight: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach ``values`` of the dictionary row with the same ``key``.

    ``weight`` names the dictionary column that counts the fact rows of each
    key. Keys with more than ``hot_rows`` fact rows (the largest
    ``MAX_HOT_KEYS`` of them, so the broadcast has a fixed bound) are resolved
    by a broadcast join; their rows then carry a random key into the ordinary
    join, so they spread over all its partitions. Everything else, including
    hot keys past the bound, goes through the ordinary join.
    """
    plain = dictionary.select(key, *values)
    if weight is None:
        return facts.join(plain, key, "left")
    hot = (dictionary.filter(F.col(weight) > hot_rows)
           .orderBy(F.col(weight).desc(), key).limit(MAX_HOT_KEYS)
           .select(F.col(key).alias("_hot"), F.struct(*values).alias("_hot_values")))
    is_hot = F.col("_hot").isNotNull()
    spread_by = ["row_id"] if "row_id" in facts.columns else facts.columns
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("string")
    cold = plain.select(F.col(key).cast("string").alias("_key"), F.lit(0).alias("_side"),
                        F.struct(*values).alias("_cold_values"))
    joined = (facts.join(F.broadcast(hot), facts[key] == hot["_hot"], "left")
              .withColumn("_key", F.when(is_hot, spread).otherwise(F.col(key).cast("string")))
              .withColumn("_side", is_hot.cast("int"))
              .join(cold, ["_key", "_side"], "left"))
    picked = F.coalesce(F.col("_hot_values"), F.col("_cold_values"))
    return joined.select(*facts.columns, *[picked[v].alias(v) for v in values])
