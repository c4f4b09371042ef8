"""Ranks over groups that may hold a large part of all rows.

A plain ``row_number`` puts a whole group in one task. Here the order is cut
into slices first: rows are ranked inside a slice, and each slice starts at
the number of rows in the slices before it. Only the small table of slice
sizes is ordered per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialise


def sliced_rank(df: DataFrame, keys: list[str], slice_cols: dict[str, Column],
                order: list, out: str) -> DataFrame:
    """1-based rank of each row within ``keys``.

    ``slice_cols`` (name to expression, most significant first, ascending)
    must sort before ``order``: ordering by the slices and then ``order`` is
    the wanted order.
    """
    for name, expr in slice_cols.items():
        df = df.withColumn(name, expr)
    parts = list(slice_cols)
    sizes = df.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_slice_size"))
    before = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, *parts,
                          F.coalesce(F.sum("_slice_size").over(before), F.lit(0)).alias("_slice_start"))
    inside = Window.partitionBy(*keys, *parts).orderBy(*order)
    return (df.withColumn("_in_slice", F.row_number().over(inside))
            .join(starts, keys + parts)
            .withColumn(out, F.col("_slice_start") + F.col("_in_slice"))
            .drop("_slice_start", "_in_slice", *parts))


def last_per_group(df: DataFrame, keys: list[str], order: list, n: int,
                   out: str = "age_rank") -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Spark cuts each map task's output to ``n`` rows per group before the
    shuffle, so a hot group costs ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= n)


ID_BITS = 20


def ids_by_first_appearance(df: DataFrame, value: str, out: str, first: int = 0,
                            row_id: str = "row_id") -> DataFrame:
    """Distinct values with a dense id in order of first appearance.

    Returns ``value``, ``out``, ``first_row`` and ``n_rows``.
    """
    seen = df.groupBy(value).agg(F.min(row_id).alias("first_row"),
                                 F.count(F.lit(1)).alias("n_rows"))
    ranked = sliced_rank(seen, [], {"_block": F.shiftright("first_row", ID_BITS)},
                         [F.col("first_row")], out)
    return ranked.withColumn(out, F.col(out) - 1 + first)


def dense_order(df: DataFrame, order: list, out: str = "ordinal") -> DataFrame:
    """1-based position of every row in one global order, without a hot task.

    Rows are range-partitioned (Spark samples the bounds, so equal work per
    partition), sorted inside partitions and written once; a row's position
    is its place in the partition plus the size of the partitions before it.
    ``order`` must be a total order.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = materialise(placed, "ordered")
    part = F.shiftright(F.col("_at"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per shuffle partition, so the broadcast is bounded.
    return (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
            .drop("_part", "_start", "_at"))
