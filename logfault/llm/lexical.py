"""Exact ranked lexical search over forests of sparse ball trees.

A document is the sparse vector of its saturated term counts, an item the
vector of its terms' weights; the score is their inner product. Only terms of
items matter, so a first pass keeps each document's counts of these (small
rows, written once) and its length; corpus statistics come from that table.

Each task then builds ball trees over its documents, ``CHUNK`` at a time: a
node has the centroid of its vectors and the largest distance from it, and is
split at the median along the direction in which its vectors differ most. The score of any document
below a node is at most ``q . centroid + |q| radius``; as an item has few of
the terms along which the vectors of a ball differ, the largest value of each
term below the node gives a second bound, and the lesser counts. An item walks a tree
best bound first and leaves out every subtree whose bound, rounded upwards,
is below its k-th best score so far.
Leaves are scored exactly, in 64-bit integers. A task returns at most ``k``
rows per item, from which the best are taken.

Nothing but these rows is shuffled. Items are sent to the tasks in batches of
about ``BATCH_BYTES`` of text, as many as it takes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import id_of, row_key, text_of

#: Documents of one tree, and of a leaf.
CHUNK, LEAF = 8192, 64
#: Term counts that one tree holds at most (a single larger document is a tree of its own).
CHUNK_TERMS = 4_000_000
#: Bytes of item texts that are sent to the tasks at once, about.
BATCH_BYTES = 16 << 20
TOP = 50
#: Power iterations that turn a split towards the direction of most difference.
TURNS = 3
#: Bounds are raised by this share and by one: far more than doubles can lose in a sum.
SLACK = 1e-8

_TERMS = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return data.translate(_TERMS).split()


_VECTORS = "key long, n long, ids array<int>, counts array<int>"
_LISTS = pa.list_(pa.int32())


def _project(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            lengths, sizes, ids, counts = [], [0], [], []
            for text in batch["text"]:
                words = terms_of(text.as_buffer().to_pybytes())
                lengths.append(len(words))
                found = np.array([i for i in map(number, words) if i is not None], np.int32)
                found, count = np.unique(found, return_counts=True)
                ids.append(found)
                counts.append(count.astype(np.int32))
                sizes.append(sizes[-1] + len(found))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *x]), pa.int32()))
                     for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch["key"].cast(pa.int64()), pa.array(lengths, pa.int64()), *lists],
                                             names=["key", "n", "ids", "counts"])
    return run


class Rows:
    """Sparse rows: ``starts`` has one entry per row and one more; no row is empty."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.starts, self.ids, self.values = keys, starts, ids, values

    def __len__(self) -> int:
        return len(self.keys)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        starts = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(self.keys[rows], starts, self.ids[at], self.values[at])

    def dot(self, dense: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
        values = self.values if scale is None else self.values * scale[self.ids]
        return np.add.reduceat(values * dense[self.ids], self.starts[:-1])


class Tree:
    """A ball tree; nodes are numbered, ``children`` is None for leaves, which keep their rows."""

    def __init__(self, rows: Rows, scale: np.ndarray, leaf: int = LEAF) -> None:
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[Rows | None] = []
        self.centroids: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._scale, self._leaf = scale, leaf
        self._dense = np.zeros(len(scale))
        todo = [(rows, -1, 0)]
        while todo:
            part, parent, side = todo.pop()
            node = len(self.radius)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            halves = self._add(part)
            if halves:
                todo += [(half, node, i) for i, half in enumerate(halves)]

    def _add(self, rows: Rows) -> list[Rows] | None:
        scaled = rows.values * self._scale[rows.ids]
        norms = np.add.reduceat(scaled * scaled, rows.starts[:-1])
        order = np.argsort(rows.ids, kind="stable")
        ordered = rows.ids[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        used, by_term = ordered[first], scaled[order]
        centre = np.add.reduceat(by_term, first) / len(rows)
        length = float(centre @ centre)
        self._dense[used] = centre
        far = norms - 2 * np.add.reduceat(scaled * self._dense[rows.ids], rows.starts[:-1]) + length
        self._dense[used] = 0
        # Differences of large numbers: what they can lose is added.
        radius = math.sqrt(max(0.0, float((far + 1e-12 * (norms + length)).max())))
        self.centroids.append((used, centre, np.maximum.reduceat(by_term, first)))
        self.radius.append(radius)
        self.children.append(None)
        if len(rows) <= self._leaf or radius * radius <= 1e-9 * length:
            self.rows.append(rows)
            return None
        self.rows.append(None)

        # From the line between two far-off vectors to the direction in which all vectors differ most.
        sizes = np.diff(rows.starts)
        along = np.zeros(len(used))
        one = int(far.argmax())
        to_one = self._along(rows, scaled, one)
        for row, sign in ((one, 1.0), (int((norms - 2 * to_one).argmax()), -1.0)):
            a, b = rows.starts[row], rows.starts[row + 1]
            along[np.searchsorted(used, rows.ids[a:b])] += sign * scaled[a:b]
        for turn in range(TURNS + 1):
            self._dense[used] = along
            place = np.add.reduceat(scaled * self._dense[rows.ids], rows.starts[:-1])
            self._dense[used] = 0
            if turn < TURNS:
                place -= place.mean()
                along = np.add.reduceat((scaled * np.repeat(place, sizes))[order], first) - place.sum() * centre
                size = float(np.abs(along).max())
                if size == 0:
                    break
                along /= size
        order = np.argsort(place, kind="stable")
        half = len(order) // 2
        return [rows.take(np.sort(order[:half])), rows.take(np.sort(order[half:]))]

    def _along(self, rows: Rows, scaled: np.ndarray, row: int) -> np.ndarray:
        """Inner products of all rows with one of them."""
        a, b = rows.starts[row], rows.starts[row + 1]
        self._dense[rows.ids[a:b]] = scaled[a:b]
        out = np.add.reduceat(scaled * self._dense[rows.ids], rows.starts[:-1])
        self._dense[rows.ids[a:b]] = 0
        return out

    def bounds(self, starts: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each node and query (rows of ``ids`` and scaled ``values``) what no score below can exceed."""
        norms = np.sqrt(np.add.reduceat(values * values, starts[:-1]))
        out = np.empty((len(self.radius), len(norms)))
        for node, (used, centre, peak) in enumerate(self.centroids):
            self._dense[used] = centre
            ball = np.add.reduceat(self._dense[ids] * values, starts[:-1]) + norms * self.radius[node]
            self._dense[used] = peak
            out[node] = np.minimum(ball, np.add.reduceat(self._dense[ids] * values, starts[:-1]))
            self._dense[used] = 0
        return out * (1 + SLACK) + 1


def search(tree: Tree, bound: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], top: int) -> int:
    """Walk ``tree`` best bound first for the query with dense integer ``weights``; returns the leaves seen.

    ``best`` is a heap of (score, -key) with at most ``top`` entries.
    """
    heap, seen = [(-bound[0], 0)], 0
    while heap:
        upper, node = heapq.heappop(heap)
        if len(best) == top and -upper < best[0][0]:
            break  # all others have lower bounds still
        if tree.children[node] is not None:
            for child in tree.children[node]:
                heapq.heappush(heap, (max(upper, -bound[child]), child))
            continue
        seen += 1
        rows = tree.rows[node]
        scores = rows.dot(weights)
        least = best[0][0] if len(best) == top else 1
        for i in np.flatnonzero(scores >= least).tolist():
            entry = (int(scores[i]), -int(rows.keys[i]))
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return seen


def saturated(counts: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The value of a term that occurs ``counts`` times among ``n`` terms of a document."""
    m = 50 + (50 * n * documents) // words
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def _search(queries, documents: int, words: int, top: int, chunk: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ids, weight_of = queries.value
        scale = np.sqrt(weight_of.astype(float))
        count = len(starts) - 1
        best: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        weights = np.zeros(len(weight_of), np.int64)
        held: list[Rows] = []

        def settle() -> None:
            if not held:
                return
            shifts = np.cumsum([0] + [r.starts[-1] for r in held])
            rows = Rows(np.concatenate([r.keys for r in held]),
                        np.concatenate([r.starts[:-1] + s for r, s in zip(held, shifts)] + [shifts[-1:]]),
                        np.concatenate([r.ids for r in held]), np.concatenate([r.values for r in held]))
            held.clear()
            tree = Tree(rows, scale, leaf)
            bounds = tree.bounds(starts, ids, scale[ids])
            for q in range(count):
                own = ids[starts[q]:starts[q + 1]]
                weights[own] = weight_of[own]
                search(tree, bounds[:, q], weights, best[q], top)
                weights[own] = 0

        for batch in batches:
            lists = batch["ids"]
            edges = lists.offsets.to_numpy().astype(np.int64)
            edges -= edges[0]
            sizes = np.diff(edges)
            n = np.repeat(batch["n"].to_numpy(), sizes)
            flat = lists.flatten().to_numpy()
            values = saturated(batch["counts"].flatten().to_numpy().astype(np.int64), n, documents, words)
            full = sizes > 0
            rows = Rows(batch["key"].to_numpy()[full], np.r_[0, np.cumsum(sizes[full])], flat, values)
            at = 0
            while at < len(rows):
                room = chunk - sum(map(len, held))
                spare = CHUNK_TERMS - sum(int(r.starts[-1]) for r in held)
                end = min(at + room, max(at + (not held), int(np.searchsorted(rows.starts, rows.starts[at] + spare, "right")) - 1))
                if end <= at:
                    settle()
                    continue
                held.append(rows.take(np.arange(at, end)))
                at = end
                if sum(map(len, held)) >= chunk:
                    settle()
        settle()
        found = [(q, -key, score) for q in range(count) for score, key in best[q]]
        columns = zip(*found) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
                                         names=["q", "key", "score"])
    return run


def ranked_search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", top: int = TOP, chunk: int = CHUNK, leaf: int = LEAF,
                  batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The ``top`` documents with a score above 0 for each item: ``item_id, rank, doc_id, score``.

    Equal scores rank by ascending id, a null id first. Null and empty texts
    have no terms: such documents never match and do not count, such items
    give no rows. Repeated documents count and rank as often as they occur, a
    repeated item (id and text) is asked once; items that share an id but not
    the text are ranked apart. Other columns are not read.
    """
    spark = df.sparkSession
    asked = items.select(row_key(item_col).alias("item"), text_of(item_text_col).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    docs = df.select(row_key(id_col).alias("key"), text_of(text_col).alias("text"))
    out = None
    for i in range(batches):
        # About ``batch_bytes`` of text.
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(batches)) == i).orderBy("item", "text").collect()
        found = _batch(docs, [(r["item"], sorted(set(terms_of(r["text"].encode("utf-8", "surrogatepass"))))) for r in rows], top, chunk, leaf)
        out = found if out is None else out.unionByName(found)
    return out


def _batch(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int, chunk: int, leaf: int) -> DataFrame:
    spark = docs.sparkSession
    items = [(item, words) for item, words in items if words]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, words in items for t in words))}
    sent = spark.sparkContext.broadcast(vocabulary)
    vectors = materialise(docs.mapInArrow(_project(sent), _VECTORS), "vectors")
    documents, words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    # At most one row per term of the batch.
    for row in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():
        df[row["id"]] = row["count"]
    weight_of = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    ids = np.array([vocabulary[t] for _, own in items for t in own], np.int64)
    starts = np.cumsum([0] + [len(own) for _, own in items])
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], "q int, item long")
    if items and words:
        asked = spark.sparkContext.broadcast((starts, ids, weight_of))
        found = vectors.select("key", "n", "ids", "counts").mapInArrow(
            _search(asked, documents, words, top, chunk, leaf), "q int, key long, score long")
    else:
        found = spark.createDataFrame([], "q int, key long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "key")
    kept = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return kept.join(F.broadcast(names), "q").select(id_of("item").alias("item_id"), "rank", id_of("key").alias("doc_id"), "score")
