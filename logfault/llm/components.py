"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop_scratch, materialise, scratch_mark


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: link the larger (or smaller) neighbours of a node to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    pairs = both.join(least, "u")
    if small:
        out = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = pairs.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` long): the least node reachable.

    Each round is written to the shared folder, so its lineage is one step
    long. Rounds grow with the logarithm of the longest path. Links to
    oneself and repeated links do no harm; nodes without links get no row.
    """
    mark = scratch_mark()
    edges = materialise(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    state = None
    while True:
        edges = materialise(_star(_star(edges, small=False), small=True), "stars")
        drop_scratch(edges.sparkSession, mark, keep_last=True)  # the round before
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
