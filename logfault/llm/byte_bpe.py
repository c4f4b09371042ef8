"""Byte-level BPE by replaying the merges over a corpus of distinct words.

Each task gathers the words of a few megabytes of text. An inverted index
leads from a mergeable pair to its places in the distinct words; the pairs are
taken in rank order, merged at all their places, and only the neighbours of a
merged place get new entries. A word is merged once however often it occurs,
and the words that a task knows are kept for its next texts.

The replay runs over the words that one task has read, not over a dictionary
of all words: that dictionary grows with the corpus, and sending each task its
share of it costs more than merging again (README).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .packing import PATTERN

#: Bytes of text whose words are merged together.
BATCH_BYTES = 16 << 20
#: Parts of texts that a task remembers.
REMEMBERED = 250_000

_RUN = re.compile(r"\s\s")
_SHIFT = 20


class Vocabulary:
    """Tokens by rank and the rank of every pair of tokens that joins to a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.decimal = {i: b"%d" % i for i in self.tokens}
        of = self.ranks.get
        pairs = {}
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = of(token[:at]), of(token[at:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where a pair joins to no token or a side is not a token."""
        key = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def merge_one(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one word: lowest rank first, leftmost of equals."""
    ids = vocabulary.bytes[np.frombuffer(word, np.uint8)].tolist()
    while True:
        found = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := vocabulary.pairs.get(a << _SHIFT | b)) is not None]
        if not found:
            return ids
        rank, at = min(found)
        ids[at:at + 2] = [rank]


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each word (none empty), all words merged together in rank order.

    ``pair`` holds for each place the rank of the pair that starts there; the
    index ``places`` leads from a rank to such places and may hold outdated
    ones, which ``pair`` tells. If a merge makes a pair of no higher rank in a
    word that merges at another place in the same step, the order within the
    word matters, and the word is merged on its own instead.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    size = int(ends[-1]) + 1 if len(words) else 0
    if not size:
        return []
    gap = np.zeros(size, bool)
    gap[ends] = True  # a place after each word; no pair crosses it
    ids = np.full(size, -1, np.int32)
    ids[~gap] = vocabulary.bytes[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
    pair = np.full(size, -1, np.int32)
    pair[:-1] = vocabulary.pair_ranks(ids[:-1], ids[1:])
    places: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def index(at: np.ndarray) -> None:
        """Enter places under the ranks of their pairs."""
        ranks = pair[at]
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for a, b, rank in zip(edges, edges[1:], ranks[edges[:-1]].tolist()):
            if rank in places:
                places[rank].append(at[a:b])
            else:
                places[rank] = [at[a:b]]
                heapq.heappush(queue, rank)

    alone: set[int] = set()
    index(np.arange(size))
    while queue:
        rank = heapq.heappop(queue)
        found = places.pop(rank)
        at = np.unique(np.concatenate(found) if len(found) > 1 else found[0])
        at = at[pair[at] == rank]
        if not len(at):
            continue
        right = after[at]
        if (touch := np.flatnonzero(right[:-1] == at[1:])).size:
            keep = np.ones(len(at), bool)
            for i in touch.tolist():
                if keep[i]:
                    keep[i + 1] = False
            at, right = at[keep], right[keep]
        end = after[right]
        if (next_to := np.flatnonzero(end[:-1] == at[1:])).size:
            # Between two merges side by side, the first one's token stood before the second one's left part.
            between = vocabulary.pair_ranks(np.full(len(next_to), rank, np.int32), ids[at[next_to + 1]])
            alone |= set(np.searchsorted(ends, at[next_to[(between >= 0) & (between <= rank)]]).tolist())
        ids[at], ids[right], pair[right] = rank, -2, -1
        after[at], before[end] = end, at
        left = before[at]
        changed = np.unique(np.concatenate([left[left >= 0], at]))
        new = vocabulary.pair_ranks(ids[changed], ids[after[changed] - (after[changed] == size)])
        pair[changed] = new
        index(changed)
        if (early := changed[(new >= 0) & (new <= rank)]).size:
            in_words = np.searchsorted(ends, at)
            twice = set(in_words[1:][in_words[1:] == in_words[:-1]].tolist())
            alone |= twice & set(np.searchsorted(ends, early).tolist())
    kept = ids >= 0
    cuts = np.cumsum(kept)[ends]
    out = np.split(ids[kept], cuts[:-1])
    for word in alone:
        out[word] = np.array(merge_one(words[word], vocabulary), np.int32)
    return out


class Encoder:
    """Ids (as 32-bit numbers in bytes) and their decimal text for parts of texts, remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import regex
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.remembered = remembered
        self.parts: dict[str, tuple[bytes, bytes]] = {}

    def split(self, text: str) -> list[str]:
        """Parts whose ids follow each other; a blank before a word and a single line break start new ones."""
        if _RUN.search(text) or "\0" in text:
            return [text]
        return [p for p in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if p]

    def learn(self, parts: Iterable[str]) -> None:
        if len(self.parts) > self.remembered:
            self.parts.clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.parts]
        cut = [self.pattern.findall(p) for p in new]
        known = self.vocabulary.ranks
        words = list(dict.fromkeys(w for ws in cut for w in ws))
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        decimal = self.vocabulary.decimal
        merged: dict[str, tuple[bytes, bytes]] = {}
        todo: list[int] = []
        for i, (word, data) in enumerate(zip(words, raw)):
            if (rank := known.get(data)) is None:
                todo.append(i)
            else:
                merged[word] = rank.to_bytes(4, "little"), decimal[rank]
        for i, ids in zip(todo, replay([raw[i] for i in todo], self.vocabulary)):
            merged[words[i]] = ids.tobytes(), b" ".join([decimal[x] for x in ids.tolist()])
        for part, ws in zip(new, cut):
            if len(ws) == 1:
                self.parts[part] = merged[ws[0]]
            else:
                found = [merged[w] for w in ws]
                self.parts[part] = b"".join([x for x, _ in found]), b" ".join([x for _, x in found])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        split = [self.split(t) for t in texts]
        self.learn(p for parts in split for p in parts)
        of = self.parts
        for parts in split:
            found = [of[p] for p in parts]
            yield np.frombuffer(b"".join([x for x, _ in found]), "<i4"), b" ".join([x for _, x in found])


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def encoded(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``.

    ``vocabulary`` is the path of a rank file that every task can read. Null
    and empty texts have no tokens; repeated rows give equal rows. The hash of
    the decoded bytes is taken from what the ids decode to. Columns other than
    id and text play no part; ``ids`` is null unless ``keep_ids``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            at, keys, texts = 0, batch["doc_id"], batch["text"].to_pylist()
            for some in _batches(texts):
                rows = []
                for ids, text in encoder.encode(some):
                    decoded = encoder.vocabulary.decode(ids.tolist())
                    rows.append((len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(decoded).hexdigest(),
                                 ids if keep_ids else None))
                n, a, b, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(some)), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(ids, pa.list_(pa.int32()))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                at += len(some)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, _OUT)


def decoded(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``text``, the text that its ids stand for; broken characters become U+FFFD, null stays null."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        tokens = _encoder(vocabulary).vocabulary
        return pd.Series([None if i is None else tokens.decode(i).decode("utf-8", "replace") for i in ids], dtype=object)
    return df.withColumn("text", text(F.col(ids_col)))
