"""Over-sampling of minority classes with mixed numeric and text columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import last_per_group, sliced_rank
from ..sources.scratch import materialise

#: Distinct points of a cell, about, and rows of either side that one task compares at once.
CELL_ROWS, BLOCK_ROWS = 512, 4_096
NEIGHBOURS = 5
_POINT = "label int, point bigint, numbers array<double>, texts array<bigint>, keys array<bigint>"


def _distances(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray, penalty: float) -> np.ndarray:
    """Squared distances of rows with numbers ``a, b`` and texts ``s, t``; equal rows have exactly 0."""
    out = np.zeros((len(a), len(b)))
    for one, two in zip(a.T, b.T):
        out += np.square(one[:, None] - two[None, :])
    for one, two in zip(s.T, t.T):
        out += penalty * (one[:, None] != two[None, :])
    return out


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind).reshape(len(column), -1)


def text_penalty(df: DataFrame, numeric: list[str]) -> float:
    """Half the squared median of the standard deviations in the smallest class (ties: the lowest label)."""
    spreads = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(c) for c in numeric])
    smallest = spreads.orderBy("n", "label").first()
    median = float(np.median([smallest[c] or 0.0 for c in numeric])) if numeric and smallest else 1.0
    return median * median / 2


def points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct points of a class with the ``k + 1`` smallest keys of their rows.

    Of rows at one place no other can be among the ``k`` nearest of any row, so
    a class of copies is one point.
    """
    few = last_per_group(rows, ["label", "numbers", "texts"], [F.col("key")], k + 1)
    grouped = few.groupBy("label", "numbers", "texts").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return grouped.select("label", F.col("keys")[0].alias("point"), "numbers", "texts", "keys")


class Pivots:
    """A few points of each class; every other point belongs to the cell of the nearest one.

    A class of n points has about n / ``CELL_ROWS`` pivots and at most the
    root of n, so they and their cells' figures are small tables.
    """

    def __init__(self, every: DataFrame, k: int, penalty: float, cell_rows: int = CELL_ROWS) -> None:
        self.k, self.penalty = k, penalty
        sizes = {r["label"]: r["count"] for r in every.groupBy("label").count().collect()}
        wanted = {label: max(1, -(-n // max(cell_rows, math.isqrt(n)))) for label, n in sizes.items()}
        picked = last_per_group(every, ["label"], [F.xxhash64("point"), F.col("point")], max(wanted.values(), default=1), "_nth")
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows = [r for r in picked.collect() if r["_nth"] <= wanted[r["label"]]]
        for label in sizes:
            own = sorted((r for r in rows if r["label"] == label), key=lambda r: r["_nth"])
            self.of[label] = (np.array([r["numbers"] for r in own], float).reshape(len(own), -1),
                              np.array([r["texts"] for r in own], np.int64).reshape(len(own), -1))
        self.radius: dict[int, np.ndarray] = {}
        self.near: dict[int, np.ndarray] = {}

    def distances(self, label: int, numbers: np.ndarray, texts: np.ndarray) -> np.ndarray:
        return np.sqrt(_distances(numbers, texts, *self.of[label], self.penalty))

    def place(self, every: DataFrame) -> DataFrame:
        """Points with their ``cell`` and the ``far`` distance to its pivot."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, label, d in self._parts(batches):
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                                                 names=[*batch.schema.names, "cell", "far"])
        return every.mapInArrow(run, _POINT + ", cell int, far double")

    def _parts(self, batches: Iterator[pa.RecordBatch]):
        """Rows of one label at a time with their distances to its pivots."""
        for batch in batches:
            labels = batch["label"].to_numpy()
            for label in np.unique(labels).tolist():
                part = batch.filter(pa.array(labels == label))
                step = max(1, 4_000_000 // (len(self.of[label][0]) * (self.k + 2)))
                for a in range(0, part.num_rows, step):
                    piece = part.slice(a, step)
                    yield piece, label, self.distances(label, _matrix(piece["numbers"], float), _matrix(piece["texts"], np.int64))

    def measure(self, cells: DataFrame) -> None:
        """The radius of each cell, and how near the ``k + 1`` candidates nearest to its pivot are."""
        first = last_per_group(cells.select("label", "cell", "far", "point", F.explode("keys")), ["label", "cell"],
                               [F.col("far"), F.col("point"), F.col("col")], self.k + 1)
        figures = first.groupBy("label", "cell").agg(F.sort_array(F.collect_list("far")).alias("near")).join(
            cells.groupBy("label", "cell").agg(F.max("far").alias("radius")), ["label", "cell"]).collect()
        for label, (numbers, _) in self.of.items():
            self.radius[label] = np.full(len(numbers), -np.inf)
            self.near[label] = np.full((len(numbers), self.k + 1), np.inf)
        for r in figures:
            self.radius[r["label"]][r["cell"]] = r["radius"]
            self.near[r["label"]][r["cell"], :len(r["near"])] = r["near"]

    def asking(self, cells: DataFrame) -> DataFrame:
        """Each point once per ``asked`` cell that may hold one of its ``k + 1`` nearest candidates.

        By the triangle inequality nothing in a cell is farther than its
        pivot plus the radius, or nearer than the pivot minus it.
        """
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, label, d in self._parts(batches):
                reach = (d[:, :, None] + self.near[label]).reshape(len(d), -1)
                most = np.partition(reach, min(self.k, reach.shape[1] - 1), axis=1)[:, min(self.k, reach.shape[1] - 1)]
                row, cell = np.nonzero(d - self.radius[label] <= most[:, None] * (1 + 1e-9) + 1e-9)
                part = batch.select(["label", "point", "numbers", "texts"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32())], names=[*part.schema.names, "asked"])
        return cells.select("label", "point", "numbers", "texts", "keys").mapInArrow(
            run, "label int, point bigint, numbers array<double>, texts array<bigint>, asked int")


def _compare(k: int, penalty: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"point": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        sizes = right["keys2"].map(len).to_numpy()
        keys = np.concatenate(right["keys2"].to_numpy())
        order = np.argsort(keys, kind="stable")
        at = np.repeat(np.arange(len(right)), sizes)[order]
        stack = lambda column, kind: np.array(column.tolist(), kind).reshape(len(column), -1)
        b, t = stack(right["numbers2"], float)[at], stack(right["texts2"], np.int64)[at]
        out = []
        for start in range(0, len(left), 256):
            part = left.iloc[start:start + 256]
            d = _distances(stack(part["numbers"], float), stack(part["texts"], np.int64), b, t, penalty)
            near = np.argsort(d, axis=1, kind="stable")[:, :k + 1]  # equal distances by key
            out.append(pd.DataFrame({"point": np.repeat(part["point"].to_numpy(), near.shape[1]), "near": keys[order][near.ravel()],
                                     "distance": np.take_along_axis(d, near, axis=1).ravel()}))
        return pd.concat(out)
    return run


def neighbours(df: DataFrame, numeric: list[str], text: list[str], k: int = NEIGHBOURS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``key, near, distance, rank``: the exact ``k`` nearest rows of the same class, equal distances by key.

    Squared Euclidean distance of the numeric columns; a differing text column
    adds half the squared median of the standard deviations in the smallest
    class. With an equal sign for each text that is a Euclidean distance, so
    the triangle inequality holds: rows fall into the cells of a few pivots,
    and a row only meets cells that can hold one of its nearest. Cells and
    their askers are cut into blocks of bounded size.
    """
    penalty = text_penalty(df, numeric)
    rows = df.select("key", F.col("label").cast("int").alias("label"), F.array(*[F.col(c).cast("double") for c in numeric]).alias("numbers"),
                     F.transform(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text]),
                                 lambda t: F.xxhash64(t)).alias("texts"))
    every = materialise(points(rows, k), "points")
    pivots = Pivots(every, k, penalty, cell_rows)
    cells = materialise(pivots.place(every), "cells")
    pivots.measure(cells)
    asking = materialise(pivots.asking(cells), "asking")
    # At most one row per cell.
    askers = asking.groupBy("label", F.col("asked").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("slices"))
    holders = cells.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    cut = F.broadcast(askers.join(holders, ["label", "cell"]))

    def numbered(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = lambda n: F.pmod(F.xxhash64("point"), F.col(n)).cast("int")
    left = asking.withColumnRenamed("asked", "cell").join(cut, ["label", "cell"]).select(
        "label", "cell", own("slices").alias("slice"), numbered("blocks").alias("block"), "point", "numbers", "texts")
    right = cells.join(cut, ["label", "cell"]).select(
        F.col("label").alias("label2"), F.col("cell").alias("cell2"), numbered("slices").alias("slice2"), own("blocks").alias("block2"),
        F.col("numbers").alias("numbers2"), F.col("texts").alias("texts2"), F.col("keys").alias("keys2"))
    found = (left.groupBy("label", "cell", "slice", "block").cogroup(right.groupBy("label2", "cell2", "slice2", "block2"))
             .applyInPandas(_compare(k, penalty), "point bigint, near bigint, distance double"))
    best = (last_per_group(found, ["point"], [F.col("distance"), F.col("near")], k + 1)
            .groupBy("point").agg(F.sort_array(F.collect_list(F.struct("distance", "near"))).alias("best")))
    placed = every.select("point", "label", "numbers", "texts").join(best, "point").drop("point")
    others = F.slice(F.filter("best", lambda x: x["near"] != F.col("key")), 1, k)
    joined = rows.join(placed, ["label", "numbers", "texts"]).select("key", F.posexplode(others).alias("rank", "x"))
    return joined.select("key", F.col("x.near").alias("near"), "x.distance", (F.col("rank") + 1).alias("rank"))


def oversample(df: DataFrame, numeric: list[str], text: list[str], k: int = NEIGHBOURS, seed: int = 0) -> DataFrame:
    """Raise every class to the size of the largest.

    ``df`` has a unique BIGINT ``key``, ``label`` and the named columns. New
    rows lie between a row and one of its ``k`` neighbours in the class;
    text columns take the neighbours' most common value (ties: alphabet).
    New rows have ``is_new`` true and the key of the row they start from.
    """
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    # One row per class.
    wanted = F.broadcast(sizes.filter(F.col("n") < largest).withColumn("missing", F.lit(largest) - F.col("n")))
    minority = df.join(wanted.select("label", "n", "missing"), "label")
    minority = minority.withColumn("_hash", F.md5(F.concat(F.col("key").cast("string"), F.lit(f"-{seed}"))))
    ranked = sliced_rank(minority, ["label"], {"_lead": F.substring("_hash", 1, 3)}, ["_hash", "key"], "_rank")
    copies = F.floor(F.col("missing") / F.col("n")) + (F.col("_rank") <= F.col("missing") % F.col("n")).cast("int")
    near = neighbours(minority.select("key", "label", *numeric, *text), numeric, text, k)
    votes = near.drop("distance").join(df.select(F.col("key").alias("near"), *numeric, *text), "near")

    def majority(name):
        values = F.transform("_near", lambda r: r[name])
        counted = F.sort_array(F.transform(F.array_distinct(values), lambda v: F.struct(
            (-F.size(F.filter(values, lambda x: x.eqNullSafe(v)))).alias("n"), v.alias("v"))))
        return F.get(counted, F.lit(0))["v"]

    around = votes.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct("rank", *numeric, *text))).alias("_near"))
    seeded = (ranked.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int")))))
              .join(around, "key"))

    def uniform(tag):
        text_key = F.concat_ws("-", F.col("key").cast("string"), F.col("_copy").cast("string"), F.lit(f"{tag}{seed}"))
        return F.conv(F.substring(F.md5(text_key), 1, 8), 16, 10).cast("double") / float(1 << 32)

    partner = F.get("_near", F.floor(uniform("n") * F.size("_near")).cast("int"))
    made = seeded.withColumn("_other", partner).withColumn("_step", uniform("s")).select(
        "key", "label",
        *[(F.col(c) + F.col("_step") * (F.col("_other")[c] - F.col(c))).cast("double").alias(c) for c in numeric],
        *[majority(c).alias(c) for c in text], F.lit(True).alias("is_new"))
    kept = df.select("key", "label", *[F.col(c).cast("double").alias(c) for c in numeric], *text,
                     F.lit(False).alias("is_new"))
    return kept.unionByName(made)
