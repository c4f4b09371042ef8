"""Best-fit packing of token sequences by sums of squares.

Texts become token ids; only texts longer than a sequence are cut, all pieces
full but the first. The pieces are dealt into groups of about ``GROUP`` by a
hash of what they are and of their place in the written table, so repeated
rows spread like any other and the number of groups follows the data and every group packs alike;
each leaves one or two sequences unfilled. A group places each piece where
the sum over gaps of (open bins with that gap) squared becomes smallest: this
keeps the gaps varied, so that later pieces find a bin that they fill.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import id_of, row_key, text_of

LENGTH = 2048
#: Pieces that one task packs together.
GROUP = 20_000
#: The id that ends each text.
END = b"\0\0\0\0"
#: Encoded parts of texts that a task remembers.
REMEMBERED = 250_000

#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = re.compile(r"\s\s")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def part_encoder(vocabulary: str):
    """A fast encoder with the ids of a byte-level tokenizer file, or None.

    If the ids follow the order of the merges, merging by ids is merging in
    that order, which tiktoken does several times faster. The tests hold both
    libraries against each other.
    """
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = _byte_letters()
    vocab = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab[t] for t in joined]
    if ids != sorted(ids) or len(set(ids)) < len(ids):
        return None
    import tiktoken
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if len(t) == 1 or i >= ids[0]}
    ranks = {t: i for t, i in ranks.items() if i <= ids[-1]}
    return tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    A text without runs of white space is encoded part by part, as a blank
    before a word and a single line break always start a new token; encoded
    parts are remembered. Other texts, and texts that hold marks of special
    tokens, are encoded whole.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(vocabulary)
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

        def encode(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        fast = part_encoder(vocabulary)

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                self[part] = ids = array("I", fast(part)).tobytes() if fast else encode(part)
                return ids

        self.encode, self.parts, self.remembered = encode, Parts({"": b""}), remembered

    def __call__(self, text: str) -> bytes:
        if _RUN.search(text) or "\0" in text or any(s in text for s in self.specials):
            return self.encode(text)
        if len(self.parts) > self.remembered:
            self.parts.clear()
            self.parts[""] = b""
        split = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.parts.__getitem__, split))


_PIECES = "key long, tag long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           length: int = LENGTH) -> DataFrame:
    """``key, tag, piece, start, length, ids_crc32``: the pieces of every text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for key, tag, text in zip(batch["key"].to_pylist(), batch["tag"].to_pylist(), batch["text"]):
                ids = encoder(text.as_py()) + END
                size = len(ids) // 4
                edges = [0, *range(size % length or length, size + 1, length)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((key, tag, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["key", "tag", "piece", "start", "length", "ids_crc32"]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    text = text_of(text_col)
    docs = df.select(row_key(id_col).alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return docs.mapInArrow(cut, _PIECES)


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each size and its place there; sizes come largest first, at most ``length``.

    ``open_[g]`` counts bins with gap g. Putting size s into a bin with gap
    g > s changes the sum of squares by 2 (open[g - s] - open[g]) + 2, filling
    a bin by 1 - 2 open[s]. Of equal changes the smallest gap is taken; a new
    bin is opened only where no bin fits.
    """
    open_ = np.zeros(length + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(length + 1)]
    used: list[int] = []
    to, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(open_[s:length]) + s
        if len(gaps):
            change = 2 * (open_[gaps - s] - open_[gaps]) + 2
            if gaps[0] == s:
                change[0] = 1 - 2 * open_[s]
            gap = int(gaps[np.argmin(change)])
            b = bins[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = length, len(used)
            used.append(0)
        to[i], place[i] = b, used[b]
        used[b] += s
        if gap > s:
            bins[gap - s].append(b)
            open_[gap - s] += 1
    return to, place


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``vocabulary`` is the path of a tokenizer file that every task can read.
    Null and empty texts are one piece with only the end id; repeated rows are
    packed as often as they occur. Columns other than id and text play no part.
    """
    cut = materialise(pieces(df, vocabulary, id_col, text_col, length), "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("key", "tag", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key", "tag", "piece"], ascending=[False, True, True, True], kind="stable")
        to, at = sum_of_squares(rows["length"].to_numpy(), length)
        rows["sequence_id"], rows["offset"] = rows["grp"].to_numpy() * (1 << 32) + to, at
        return rows.drop(columns="grp")

    packed = dealt.groupBy("grp").applyInPandas(place, _PIECES + ", sequence_id long, offset long")
    return packed.select(id_of().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
