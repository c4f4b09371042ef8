"""Every pair of alike sets of shingles that no earlier search has connected, without loss.

Of two sets with a Jaccard likeness of ``similarity`` each lacks at most
``lacks(n)`` of the other's ``n`` shingles, and both together have at most
``apart(n + m)`` shingles that are not common. Hence, without losing a pair:

1. :func:`survivors`: a set goes on only if enough of a fixed part of its
   shingles are in other sets too. Most texts are alone and end here.
2. :func:`rare_first`: of the rest, all shingles are counted. A set keeps the
   rarest of its common ones, one more than it may lack, less those that it
   alone has: alike sets have one of them in common.
3. :func:`open_pairs`: sets that share such a shingle meet, but only those of
   different groups. Parities of the shingles in 512 bits differ in no more
   bits than the sets do in shingles, which leaves few pairs to be compared.

Large groups of copies make few pairs: whatever is connected already does not
meet, and :func:`connected` first takes the nearest set of each other group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .simhash import CELL, deal_cells

#: Of ten parts of the shingles, those by which lone sets are told.
DRAWN = 3
#: Bits of the parities.
PARITY = 512
_EPS = 1e-9
_ROWS = 200_000
_SLICE = 1024
_MET = "a long, b long, root_a long, root_b long, bits long"


def lacks(size, similarity: float):
    """How many shingles of a set of so many may be missing in an alike one (a column)."""
    return (size - F.ceil(size * F.lit(similarity) - F.lit(_EPS))).cast("long")


def apart(sizes, similarity: float):
    """How many shingles alike sets of so many together may not have in common, rounded up a little."""
    return sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def _of_part(grams: np.ndarray, parts: int) -> np.ndarray:
    return grams % np.uint32(10) < parts


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of ``node`` with the sizes and all shingles of their sets."""
    for at in range(0, batch.num_rows, _SLICE):
        sets = batch["grams"].slice(at, _SLICE).to_pylist()
        yield batch["node"].slice(at, _SLICE), np.array([len(s) // 4 for s in sets], np.int64), np.frombuffer(b"".join(sets), "<u4")


def _grams(parts: int):
    """A row for each shingle of each set, of the first ``parts`` of ten parts."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, grams in _flat(batch):
                owner = np.repeat(nodes.to_numpy(), sizes)
                if parts < 10:
                    chosen = _of_part(grams, parts)
                    owner, grams = owner[chosen], grams[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int32)), pa.array(owner)], names=["gram", "node"])
    return walk


def parities(grams: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` bits, whether an odd number of the shingles falls on it."""
    at = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 9)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(bool), bitorder="little").view(np.uint64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, "<u4") for s in batch["grams"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([len(s) for s in sets], pa.int64()),
                                          pa.array([parities(s).tobytes() for s in sets], pa.binary())], names=["node", "size", "parity"])


def survivors(nodes: DataFrame, similarity: float, parts: int = DRAWN) -> DataFrame:
    """``nodes`` without those that cannot be alike to another: too few of the drawn shingles are in other sets."""
    @F.pandas_udf("long")
    def drawn(sets: pd.Series) -> pd.Series:
        return pd.Series([int(_of_part(np.frombuffer(s, "<u4"), parts).sum()) for s in sets], dtype="int64")

    shingles = nodes.select("node", "grams").mapInArrow(_grams(parts), "gram int, node long")
    common = shingles.groupBy("gram").count().filter("count > 1").select("gram")
    seen = shingles.join(common, "gram", "left_semi").groupBy(F.col("node").alias("node_")).agg(F.count("*").alias("seen"))
    size = F.length("grams") / 4
    return (nodes.join(seen, F.col("node") == F.col("node_"), "left")
            .filter(F.coalesce("seen", F.lit(0)) >= drawn("grams") - lacks(size, similarity)).select(*nodes.columns))


def rare_first(nodes: DataFrame, similarity: float) -> DataFrame:
    """``gram, node``: the shingles by which sets meet; alike sets have one of them in common.

    The order is by number of sets, then by shingle, so it is the same in all
    sets. Shingles of one set alone come first but meet nothing: no rows.
    """
    shingles = nodes.select("node", "grams").mapInArrow(_grams(10), "gram int, node long")
    common = shingles.groupBy("gram").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    listed = (shingles.join(common, "gram").groupBy(F.col("node").alias("node_"))
              .agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("list")))
    sizes = nodes.select("node", (F.length("grams") / 4).cast("long").alias("size"))
    taken = lacks(F.col("size"), similarity) + 1 - (F.col("size") - F.size("list"))
    return (listed.join(sizes, F.col("node_") == F.col("node")).withColumn("taken", taken.cast("int")).filter("taken > 0")
            .select("node", F.explode(F.expr("slice(list, 1, taken)")).alias("one")).select("one.gram", "node"))


def met(roots: np.ndarray, sizes: np.ndarray, words: np.ndarray, similarity: float, nearest: bool) -> tuple[np.ndarray, ...]:
    """Places of pairs of different groups that may be alike, and in how many bits they differ.

    With ``nearest`` each set has only the nearest one of every other group
    that it meets. Members of the largest group are not gone through.
    """
    _, group, members = np.unique(roots, return_inverse=True, return_counts=True)
    order = np.lexsort((group, members[group]))
    ranked = group[order]
    ends = np.r_[np.flatnonzero(np.diff(ranked)) + 1, len(order)]
    end_of = np.repeat(ends, np.diff(np.r_[0, ends]))
    sizes, words = sizes[order], words[order]
    found: list[tuple[np.ndarray, ...]] = []
    for x, start in enumerate(end_of.tolist()):
        if start == len(order):
            break
        both = sizes[start:] + sizes[x]
        least, most = np.minimum(sizes[start:], sizes[x]), np.maximum(sizes[start:], sizes[x])
        y = np.flatnonzero(least >= similarity * most - _EPS)
        bits = np.bitwise_count(words[start + y] ^ words[x]).sum(axis=1, dtype=np.int64)
        may_be = bits <= apart(both[y], similarity)
        y, bits = y[may_be] + start, bits[may_be]
        if nearest and len(y):
            by_group = np.lexsort((bits, ranked[y]))
            first = np.r_[True, np.diff(ranked[y[by_group]]) != 0]
            y, bits = y[by_group[first]], bits[by_group[first]]
        if len(y):
            found.append((np.full(len(y), x), y, bits))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    x, y, bits = (np.concatenate(part) for part in zip(*found))
    return order[x], order[y], bits


def _meet(similarity: float, nearest: bool):
    def solve(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((np.diff(rows["cell"]) != 0) | (np.diff(rows["block"]) != 0)) + 1
        edges = np.r_[0, new, len(rows["cell"])].tolist()
        found = []
        for a, b in zip(edges, edges[1:]):
            roots = rows["root"][a:b]
            if (roots == roots[0]).all():
                continue
            x, y, bits = met(roots, rows["size"][a:b], rows["words"][a:b], similarity, nearest)
            if len(x):
                found.append(np.stack([rows["node"][a + x], rows["node"][a + y], rows["root"][a + x], rows["root"][a + y], bits], axis=1))
        if found:
            pairs = np.concatenate(found)
            turned = pairs[:, 0] > pairs[:, 1]
            pairs[turned] = pairs[turned][:, [1, 0, 3, 2, 4]]
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(5)],
                                             names=["a", "b", "root_a", "root_b", "bits"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = {c: batch[c].to_numpy() for c in ("cell", "block", "node", "root", "size")}
            part["words"] = np.frombuffer(b"".join(batch["parity"].to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            held.append(part)
            count += batch.num_rows
            if count > _ROWS:
                rows = {c: np.concatenate([h[c] for h in held]) for c in part}
                other = np.flatnonzero((rows["cell"] != rows["cell"][-1]) | (rows["block"] != rows["block"][-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from solve({c: v[:cut] for c, v in rows.items()})
                held, count = [{c: v[cut:] for c, v in rows.items()}], count - cut
        if count:
            yield from solve({c: np.concatenate([h[c] for h in held]) for c in held[0]})
    return walk


def open_pairs(shingles: DataFrame, marks: DataFrame, groups: DataFrame, similarity: float, nearest: bool, cell: int = CELL) -> DataFrame:
    """``a, b, root_a, root_b, bits``: sets of different ``groups`` that share one of ``shingles`` and may be alike."""
    roots = groups.select(F.col("node").alias("node_"), "root")
    named = (shingles.join(roots, F.col("node") == F.col("node_"), "left")
             .select("gram", "node", F.coalesce("root", "node").alias("root")))
    mixed = named.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("gram")
    rows = materialise(named.join(mixed, "gram", "left_semi").join(marks, "node")
                       .select(F.col("gram").cast("long").alias("cell"), "node", "root", "size", "parity"), "rows")
    dealt = deal_cells(rows, "node", cell)
    return (dealt.repartition("cell", "block").sortWithinPartitions("cell", "block")
            .mapInArrow(_meet(similarity, nearest), _MET).distinct())


def marks_of(nodes: DataFrame) -> DataFrame:
    """``node, size, parity``."""
    return nodes.select("node", "grams").mapInArrow(_marks, "node long, size long, parity binary")
