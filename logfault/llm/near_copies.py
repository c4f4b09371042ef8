"""Near copies: SimHash finds candidates, the Jaccard likeness of word shingles decides.

Fingerprints of texts whose shingles agree to 0.8 differ in about ten of 64
bits, too many for the cells of :mod:`simhash`, which lose no pair within a
few bits. So fingerprints of 128 bits get the same embedding (the bit counts
of two-bit segments) and a coarser grid: each of many cells is the counts of
a few segments drawn at random. Their number per cell follows the number of texts, so that a cell
holds about ``FILL`` points by chance; the number of cells follows from the
chance that a pair at the threshold agrees in one. Within a cell come the
Manhattan distance of the counts, then the bits, and last the exact Jaccard
likeness of the two sets of shingles, for the nearest pairs first; what these
have connected needs no further comparison.

A cell of few points gives all its close pairs. A larger one holds a group of
copies and gives a minimum spanning forest of its close pairs, nearest first,
and the close pairs of the few points in the middle of each group, so a group
makes a few links per text, in each cell other ones.
Which pairs this finds is a matter of chance and distance, so an exact search
by rare shingles (:mod:`rare_shingles`) follows for all that is not connected
yet: no pair at the threshold is lost, and none below it is ever linked.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop_scratch, materialise, scratch_mark
from .common import text_of
from .components import components
from .rare_shingles import marks_of, open_pairs, rare_first, survivors
from .simhash import CELL, SEED, count_pairs, deal_cells, keep_rows

#: Words in a shingle, and the likeness at which texts are near copies.
SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of candidates, of 128; a pair at the threshold has 19 on average, with a deviation of 4.
BITS = 32
#: Differing bits up to which candidates are compared in a round of their own; three of four pairs at the threshold are below the last.
ROUNDS = (10, 14, 18, 22)
#: Points that share a cell by chance.
FILL = 48
#: Cells per point are this many times the inverse chance that a pair at the threshold agrees in one; the exact search finds the rest.
COVER = 2
#: Cells per point at least.
LEAST = 12
#: Points of a cell whose close pairs are all given.
SMALL = 128
#: Points of a group in a larger cell that link to all of it.
HUBS = 3
_ROWS = 200_000
_NODES = "doc_id long, tag long, node long, point long, other long, grams binary"
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """The hash of each word shingle, repeats included; fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(width, len(words))
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles: a bit is set if over half of them have it."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype("<u8")
        count += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<i8")[0])


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for the second half of the fingerprint."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    return mixed ^ (mixed >> np.uint64(32))


def jaccard(a: bytes, b: bytes) -> float:
    """Likeness of two sorted sets of 32-bit shingle hashes; two empty sets are alike."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def _nodes(width: int):
    """Per text its set of shingles (the low halves of their hashes), a hash of the set and its fingerprint."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            for at in range(0, batch.num_rows, 512):
                nodes, points, others, grams = [], [], [], []
                for text in texts.slice(at, 512).to_pylist():
                    hashes = np.unique(shingle_hashes(text, width))
                    low = np.unique((hashes & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes()
                    grams.append(low)
                    nodes.append(int(np.uint64(xxhash.xxh64_intdigest(low)).view(np.int64)))
                    points.append(print_of(hashes))
                    others.append(print_of(remixed(hashes)))
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["tag"], pa.array(nodes, pa.int64()), pa.array(points, pa.int64()),
                     pa.array(others, pa.int64()), pa.array(grams, pa.binary())], names=["doc_id", "tag", "node", "point", "other", "grams"])
    return of


def grid(texts: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Masks over the 64 two-bit counts of both halves, one pair per cell, for so many texts."""
    # Sets of equal size and this Jaccard likeness have this cosine; a bit differs with chance angle / pi.
    flip = math.acos(2 * similarity / (1 + similarity)) / math.pi
    agree = (1 - flip) ** 2 + flip ** 2 / 2
    entropy = 1.5  # bits in the count of two random bits
    segments = min(24, max(2, round(math.log2(max(texts, 1) / FILL + 1) / entropy)))
    draw = random.Random(SEED)
    cells = max(LEAST, math.ceil(COVER / agree ** segments))
    chosen = [draw.sample(range(64), segments) for _ in range(cells)]
    return [tuple(sum(3 << (2 * (i - half)) for i in c if half <= i < half + 32) for half in (0, 32)) for c in chosen]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of two words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _group_links(codes: np.ndarray, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) of a crowded cell: a minimum spanning forest of the pairs within ``bits``, and each group's hubs.

    Hubs are the points nearest to all of their group: edited copies of one
    text are nearer to it than to each other, but for chance.
    """
    size = len(points)
    far = np.full(size, bits + 1, np.int64)
    parent, group, total = (np.zeros(size, np.int64) for _ in range(3))
    done = np.zeros(size, bool)
    at, tree, links = 0, [], []

    def near_to(at: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(_apart(codes, codes[at]) <= bits)  # a lower bound of the bits
        return near, _apart(points[near], points[at])

    for _ in range(size):
        done[at] = True
        near, real = near_to(at)
        total[at] = (bits + 1 - real[real <= bits]).sum()
        closer = (real < far[near]) & ~done[near]
        far[near[closer]] = real[closer]
        parent[near[closer]] = at
        nearest = int(np.argmin(np.where(done, 1 << 30, far)))
        if done[nearest]:
            break
        group[nearest] = group[at] if far[nearest] <= bits else group[at] + 1  # groups are grown one after the other
        if far[nearest] <= bits:
            tree.append((parent[nearest], nearest))
        at = nearest
    order = np.lexsort((-total, group))
    first = np.r_[0, np.flatnonzero(np.diff(group[order])) + 1]
    members = np.diff(np.r_[first, size])
    for a, count in zip(first.tolist(), members.tolist()):
        for hub in order[a:a + min(HUBS, count - 1)].tolist():
            near, real = near_to(hub)
            links += [(hub, j) for j in near[real <= bits].tolist() if j != hub]
    found = np.array(tree + links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def close_pairs(cells: np.ndarray, points: np.ndarray, bits: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs; ``cells`` is sorted, ``points`` has two words per row."""
    codes = _codes(points)
    new = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
    starts = np.r_[0, new]
    sizes = np.diff(np.r_[starts, len(points)])
    run = np.repeat(np.arange(len(starts)), sizes)
    left = np.flatnonzero(np.repeat(sizes <= small, sizes))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, small):
        left = left[left + step < len(run)]
        left = left[run[left] == run[left + step]]
        if not len(left):
            break
        i = left[_apart(codes[left], codes[left + step]) <= bits]
        i = i[_apart(points[i], points[i + step]) <= bits]
        a.append(i)
        b.append(i + step)
    for at, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        i, j = _group_links(codes[at:at + size], points[at:at + size], bits)
        a.append(i + at)
        b.append(j + at)
    return np.concatenate(a), np.concatenate(b)


def _codes(x: np.ndarray) -> np.ndarray:
    """The counts of :func:`simhash.count_pairs` for an array."""
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((x | (x >> one)) & odd) | ((x & (x >> one) & odd) << one)


def _candidates(bits: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            all_rows = np.concatenate(held)
            cells = all_rows[:, :2]
            cut = len(all_rows)
            if not last:
                other = np.flatnonzero(np.any(cells != cells[-1], axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0
            held, rows = [all_rows[cut:]], len(all_rows) - cut
            if cut:
                nodes = all_rows[:cut, 4]
                points = np.ascontiguousarray(all_rows[:cut, 2:4]).view(np.uint64)
                i, j = close_pairs(cells[:cut], points, bits)
                x, y = nodes[i], nodes[j]
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), _apart(points[i], points[j])], axis=1), axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], names=["a", "b", "bits"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch[c].to_numpy() for c in ("cell", "block", "point", "other", "node")], axis=1))
                rows += batch.num_rows
                if rows > _ROWS:
                    yield from flush(False)
        if rows:
            yield from flush(True)
    return walk


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """``a, b, bits``: pairs of ``nodes`` (``node, point, other``) that a cell brings together, with their differing bits."""
    masks = grid(nodes.count(), similarity)
    keys = F.array(*(F.xxhash64(F.lit(i), *(F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(("_x", "_y"), both) if m))
                     for i, both in enumerate(masks)))
    cells = (nodes.select("node", "point", "other", count_pairs("point").alias("_x"), count_pairs("other").alias("_y"))
             .select("node", "point", "other", F.explode(keys).alias("cell")))
    dealt = deal_cells(cells, "node", cell).select("cell", "block", "point", "other", "node")
    return (dealt.repartition("cell", "block").sortWithinPartitions("cell", "block")
            .mapInArrow(_candidates(bits), "a long, b long, bits long").distinct())


def alike(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sets of shingles (``node, grams``) have this likeness.

    The likeness is at most the lesser size over the larger one, so pairs of too different sizes are not compared.
    """
    @F.pandas_udf("double")
    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(a, b) for a, b in zip(x, y)], dtype="float64")

    one = nodes.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    sizes = F.length("x"), F.length("y")
    may_be = (F.greatest(*sizes) == 0) | (F.least(*sizes) / F.greatest(*sizes) >= similarity)
    return pairs.join(one, "a").join(two, "b").filter(may_be).filter(likeness("x", "y") >= similarity).select("a", "b")


def between_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b``) that are not in one of ``groups`` (``node, root``); a node without a row is its own group."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def near_groups(nodes: DataFrame, similarity: float = SIMILARITY, bits: int = BITS, cell: int = CELL,
                rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """``node, root``: what the links between alike ``nodes`` (``node, point, other, grams``) connect.

    Candidates are compared in rounds, the nearest first (up to ``rounds``
    differing bits, the last round the rest). A pair that earlier rounds have
    connected is not compared any more: its link could not change a group.
    """
    pairs = materialise(candidates(nodes, similarity, bits, cell), "candidates")
    groups, least = None, -1
    for most in [*(r for r in rounds if r < bits), bits]:
        now = pairs.filter((F.col("bits") > least) & (F.col("bits") <= most))
        links = alike(now.select("a", "b") if groups is None else between_groups(now, groups), nodes, similarity)
        groups = components(links if groups is None else links.union(groups.select("node", "root")))
        least = most
    return groups


def all_groups(nodes: DataFrame, similarity: float = SIMILARITY, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """``node, root``: what all links between alike ``nodes`` connect, found by SimHash or not.

    Sets that cannot be alike to any other take no part. What the cells have
    not connected is compared where rare shingles meet: first each set with
    the nearest of every other group, then all pairs that are still open.
    """
    may_link = materialise(survivors(nodes.select("node", "point", "other", "grams"), similarity), "survivors")
    groups = near_groups(may_link, similarity, bits, cell)
    shingles, marks = materialise(rare_first(may_link, similarity), "shingles"), materialise(marks_of(may_link), "marks")
    for nearest in (True, False):
        pairs = open_pairs(shingles, marks, groups, similarity, nearest, cell)
        if nearest:  # of all that met in the cells, too
            pairs = pairs.groupBy("a", "root_b").agg(F.min(F.struct("bits", "b")).alias("one")).select("a", F.col("one.b").alias("b"))
        links = materialise(alike(pairs.select("a", "b"), may_link, similarity), "exact")
        if not links.isEmpty():
            groups = components(links.union(groups.select("node", "root")))
    return groups


def first_of_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                         bits: int = BITS, width: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """``df`` with one row of each group of near copies: that with the smallest id.

    Texts link whose sets of shingles of ``width`` words have a Jaccard
    likeness of ``similarity`` or more; groups are what links connect. A-Z
    counts as a-z, white space only parts words. Texts of fewer words are one
    shingle; null, empty and blank texts are alike. Of repeated rows one
    stays. Rows with a null id stay only if no row of their group has an id,
    one for each group. An empty table stays empty. All columns stay.
    """
    mark = scratch_mark()
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tag"),
                      text_of(text_col).alias("text"))
    prints = materialise(texts.mapInArrow(_nodes(width), _NODES), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("least")
    # Copies are combined before the shuffle, however many there are.
    nodes = materialise(prints.groupBy("node").agg(least, F.first("point").alias("point"), F.first("other").alias("other"),
                                                      F.first("grams").alias("grams")), "nodes")
    drop_scratch(df.sparkSession, mark, keep_last=True)  # the prints
    roots = all_groups(nodes, similarity, bits, cell).withColumnRenamed("node", "node_")
    kept = (nodes.select("node", "least").join(roots, F.col("node") == F.col("node_"), "left")
            .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
            .select(F.col("least.doc_id").alias("doc_id"), F.col("least.tag").alias("tag")))
    kept = materialise(kept, "kept")
    drop_scratch(df.sparkSession, mark, keep_last=True)
    return keep_rows(df, kept, id_col, text_col)
