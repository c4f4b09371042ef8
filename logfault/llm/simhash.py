"""SimHash near-duplicates by bit counts of segments.

A fingerprint of 64 bits becomes a point with 32 coordinates: the number of
set bits in each segment of two bits. One differing bit moves one coordinate
by one, so the Manhattan distance of two points is at most the number of
differing bits. The coordinates are dealt into ``bits + 4`` groups of
segments; two points within distance ``bits`` differ in at most ``bits``
groups, so they agree in all coordinates of at least four groups. The grid of
the range join has one cell per choice of four groups and their coordinates:
close points always share a cell. Points of one cell are held against each
other by Manhattan distance first and by their bits last.

Texts with one fingerprint are one point, and a cell gives only the links of a
spanning forest, so a large group of copies makes few rows. A crowded cell is
split into blocks that meet pairwise in separate tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import NO_ID, row_key, text_of
from .components import components

#: Differing bits at which fingerprints link.
BITS = 4
#: Words in a shingle.
SHINGLE = 4
SEED = 42
#: Points of one cell that one task holds against each other.
CELL = 4096
#: One point in this many is counted to find crowded cells.
PROBE = 64
_ODD = 0x5555555555555555


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The SimHash of a text over its word shingles, repeats included; no words give 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [hash_of(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[:len(words) - width + 1]
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1:] - 1).tolist())]
    count = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 14):
        part = values[at:at + (1 << 14)]
        count += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", width: int = SHINGLE):
    """The fingerprint of each text as a signed long column; null counts as empty."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64), dtype="int64")
    return of(text_of(text_col))


def _groups(bits: int) -> list[int]:
    """Masks over the 32 two-bit counts, one per group of segments."""
    count = bits + 4
    edges = [round(32 * i / count) for i in range(count + 1)]
    return [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(edges, edges[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cell_keys(point: str, bits: int):
    """The grid cells of a point: one for each choice of four groups."""
    masks = [_signed(sum(m)) for m in itertools.combinations(_groups(bits), 4)]
    return F.array(*(F.xxhash64(F.lit(i), F.col(point).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Pairs within ``bits``, exactly."""
    return np.bitwise_count(a ^ b) <= bits


def _count_pairs(x: np.ndarray) -> np.ndarray:
    """The bit counts of two-bit segments in unary: 0 is 00, 1 is 01, 2 is 11.

    Unary codes differ in as many bits as the counts do, so the Manhattan
    distance of two points is the number of differing bits of their codes.
    """
    odd, one = np.uint64(_ODD), np.uint64(1)
    return ((x | (x >> one)) & odd) | ((x & (x >> one) & odd) << one)


def count_pairs(column: str):
    """:func:`_count_pairs` as a column expression."""
    x, half = F.col(column), F.shiftrightunsigned(column, 1)
    odd = F.lit(_ODD)
    return x.bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(x.bitwiseAND(half).bitwiseAND(odd), 1))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(points: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (places) of a spanning forest of one cell."""
    size = len(points)
    parent = np.arange(size)
    counts = _count_pairs(points)
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(size - 1):
        near = np.flatnonzero(_manhattan(counts[i], counts[i + 1:]) <= bits) + i + 1
        if len(near):
            near = near[_close(points[i], points[near], bits)]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _links(bits: int):
    """Links within the cells of a partition that is sorted by cell."""
    def solve(cells: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = _count_pairs(points)
        new = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
        starts = np.r_[0, new]
        sizes = np.diff(np.r_[starts, len(points)])
        run = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= 16, sizes)
        a, b = [], []
        for d in range(1, 16):
            i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d]) if d < len(run) else np.zeros(0, int)
            if not len(i):
                break
            i = i[_manhattan(counts[i], counts[i + d]) <= bits]
            i = i[_close(points[i], points[i + d], bits)]
            a.append(points[i])
            b.append(points[i + d])
        for at, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
            part = points[at:at + size]
            if pairs := _forest(part, bits):
                i, j = np.array(pairs).T
                a.append(part[i])
                b.append(part[j])
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            cells = np.concatenate([c for c, _ in held])
            points = np.concatenate([p for _, p in held])
            cut = len(points)
            if not last:
                cut = int(np.flatnonzero(np.any(cells != cells[-1], axis=1))[-1]) + 1 if np.any(cells != cells[-1]) else 0
            held, rows = [(cells[cut:], points[cut:])], len(points) - cut
            if cut:
                a, b = solve(cells[:cut], points[:cut])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                                     names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                cells = np.stack([batch[c].to_numpy() for c in ("cell", "block")], axis=1)
                held.append((cells, batch["point"].to_numpy().view(np.uint64)))
                rows += batch.num_rows
                if rows > 200_000:
                    yield from flush(False)
        if rows:
            yield from flush(True)
    return walk


def links(points: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """``a, b``: links that connect all points (column ``point``) within ``bits`` of each other.

    Not every close pair is a row, but close points are always connected.
    """
    cells = (points.select("point", count_pairs("point").alias("counts"))
             .select("point", F.explode(cell_keys("counts", bits)).alias("cell")))
    dealt = deal_cells(cells, "point", cell).select("cell", "point", "block")
    return (dealt.repartition("cell", "block").sortWithinPartitions("cell", "block")
            .mapInArrow(_links(bits), "a long, b long").distinct())


def deal_cells(cells: DataFrame, member: str, cell: int = CELL) -> DataFrame:
    """``cells`` with a column ``block``; a cell of more than ``cell`` members is split into blocks that meet pairwise."""
    # Which cells are split changes only the division of work, so an estimate will do.
    crowded = materialise(
        cells.filter(F.pmod(F.xxhash64(member), F.lit(PROBE)) == 0).groupBy("cell").count()
        .filter(F.col("count") * PROBE > cell)
        .select(F.col("cell").alias("cell_"), F.ceil(F.col("count") * PROBE / (cell // 2)).cast("long").alias("blocks")),
        "crowded")
    joined = cells.join(crowded, F.col("cell") == F.col("cell_"), "left")
    own = F.pmod(F.xxhash64(member, F.lit(1)), F.col("blocks"))
    met = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                    lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)))
    return joined.select(*cells.columns, F.explode(met).alias("block"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
                width: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """``doc_id, point, component_id`` for each row of ``df``.

    ``point`` is the fingerprint as a signed long; ``component_id`` the
    smallest id reachable over links of at most ``bits`` differing bits. Null
    and empty texts have fingerprint 0 and link like any other; rows with a
    null id take part, and a group of only such rows has a null component.
    Repeated rows fall into one group. Other columns play no part.
    """
    prints = materialise(df.select(F.col(id_col).cast("long").alias("doc_id"),
                                   fingerprints(df, text_col, width).alias("point")), "fingerprints")
    return _grouped(prints, bits, cell).select("doc_id", "point", "component_id")


def _grouped(prints: DataFrame, bits: int, cell: int) -> DataFrame:
    """``prints`` with the root point and the smallest id of each row's group."""
    points = materialise(prints.groupBy("point").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("point"), bits, cell))
    rooted = points.join(roots, F.col("point") == F.col("node"), "left").select(
        "point", "least", F.coalesce("root", "point").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = rooted.join(named, "root").select(F.col("point").alias("point_"), "root", "component_id")
    return prints.join(of_point, F.col("point") == F.col("point_")).drop("point_")


def hex_of(point: str):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(point), 16, "0"))


def first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``df`` with one row of each group of near copies: that with the smallest id.

    Of repeated rows one stays. Rows with a null id stay only if no row of
    their group has an id, one for each group. All columns stay.
    """
    point = fingerprints(df, text_col)
    prints = materialise(df.select(F.col(id_col).cast("long").alias("doc_id"), point.alias("point"),
                                   F.xxhash64(text_of(text_col)).alias("tag")), "fingerprints")
    kept = (_grouped(prints, bits, CELL).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("tag").alias("tag")))
    return keep_rows(df, kept, id_col, text_col)


def keep_rows(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text hash are in ``kept`` (``doc_id, tag``), of repeated rows one."""
    kept = kept.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_key"), F.col("tag").alias("_tag"))
    # The user's columns travel in a struct, so no name can clash.
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
    left = df.select(row_key(id_col).alias("own"), F.xxhash64(text_of(text_col)).alias("text"), rest.alias("rest"))
    joined = left.join(kept, (F.col("own") == F.col("_key")) & (F.col("text") == F.col("_tag")), "left_semi")
    return joined.dropDuplicates(["own", "text"]).select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(df.columns)))
