"""Remove repeated passages with suffix arrays and longest previous factors.

A suffix array over all bytes would sort every byte of the corpus, although
few of them repeat. So windows of ``length`` bytes first meet by a
content-defined anchor: equal windows have equal anchors at equal places.

1. Each text is cut into ranges of window starts by anchor; a range keeps the
   hash of its anchor and of all bytes its windows cover.
2. Ranges with equal bytes are counted by an ordinary aggregation. All
   windows of such a range repeat, and only its first copy goes on.
3. Different ranges with one anchor meet: their bytes form a small text, its
   suffixes are sorted, and the neighbours in suffix order give for each
   window whether its longest previous (or next) factor has ``length`` bytes.
4. Anchors with more than ``limit`` different ranges would be a large group:
   their windows are hashed one by one, counted with map-side combine and
   joined back, with the same result.

Windows of a number of words can be added: they go the same way as hashes of
words, their places counted from ``WORDS`` on. Windows of bytes are then only
needed where one may hold fewer whole words.

Only pairs (id, place) and the ranges of step 3 are shuffled, and the texts
once, by id; both text joins read that one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import id_of, keyed, row_key, text_of
from .repeats import WORD_GRAM, anchors, previous_factors, sparse_windows, word_anchors, word_hashes, word_places

#: Different ranges that one local suffix array may hold for one anchor.
LIMIT = 4000
#: Classes of equal ranges that are broadcast at most.
HOT_CLASSES = 1000
#: Bytes of range text that a task sorts at once.
BATCH_BYTES = 1 << 20
#: Places from here on are those of words.
WORDS = 1 << 48

_RANGES = "key long, tag long, lo long, hi long, anchor long, content long"
_CONTEXTS = "grp long, sub long, key long, tag long, lo long, hi long, bytes binary"
_SPANS = "key long, tag long, start long, end long"
_LONG = pa.int64()


def _batch(columns: dict[str, list], binary: tuple[str, ...] = ()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.binary() if k in binary else _LONG) for k, v in columns.items()], names=list(columns))


def _ranges(length: int, words: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tag", "lo", "hi", "anchor", "content"]
        for batch in batches:
            rows: list[tuple] = []
            for key, tag, text in zip(batch["key"].to_pylist(), batch["tag"].to_pylist(), batch["text"]):
                data = text.as_buffer().to_pybytes()
                wanted = sparse_windows(data, length, words) if words else None
                rows += [(key, tag, *found) for found in anchors(data, length, wanted)]
                if words:
                    rows += [(key, tag, WORDS + lo, WORDS + hi, anchor, content)
                             for lo, hi, anchor, content in word_anchors(word_hashes(data), words)]
                if len(rows) > 50_000:
                    yield _batch(dict(zip(names, zip(*rows))))
                    rows = []
            if rows:
                yield _batch(dict(zip(names, zip(*rows))))
    return cut


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _contexts(length: int, words: int | None, limit: int):
    """The bytes (or hashes of words) of each wanted range; for large groups a hash per window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "sub", "key", "tag", "lo", "hi", "bytes"]
        seen: set[tuple[int, int]] = set()  # repeated rows are one text
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, tag, text, wanted in zip(batch["key"].to_pylist(), batch["tag"].to_pylist(),
                                              batch["text"], batch["wanted"].to_pylist()):
                if (key, tag) in seen:
                    continue
                seen.add((key, tag))
                data, hashes = text.as_buffer().to_pybytes(), None
                for one in wanted:
                    lo, hi = one["lo"], one["hi"]
                    if lo < WORDS:
                        part, unit, count = data[lo:hi + length], 1, length
                    else:
                        hashes = word_hashes(data) if hashes is None else hashes
                        part, unit, count = hashes[lo - WORDS:hi - WORDS + words].tobytes(), 8, words
                    if one["k"] <= limit:
                        rows.append((one["anchor"], 0, key, tag, lo, hi, part))
                        size += len(part)
                    else:
                        for s in range(hi - lo + 1):
                            h = xxhash.xxh3_128_intdigest(part[unit * s:unit * (s + count)])
                            rows.append((_signed(h >> 64), _signed(h & ((1 << 64) - 1)), key, tag, lo + s, lo + s, None))
                    if size > 8 << 20 or len(rows) > 50_000:
                        yield _batch(dict(zip(names, zip(*rows))), ("bytes",))
                        rows, size = [], 0
            if rows:
                yield _batch(dict(zip(names, zip(*rows))), ("bytes",))
    return cut


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _local(length: int, words: int | None, keep_first: bool):
    """Spans of repeated windows within the groups of a sorted partition."""
    def solve(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        rows = list({r[:4]: r for r in rows}.values())  # a split partition can hold a repeated row in several tasks
        yield from of_kind([r for r in rows if r[3] < WORDS], np.uint8, length)
        yield from of_kind([r for r in rows if r[3] >= WORDS], np.uint64, words)

    def of_kind(rows: list[tuple], kind: type, length: int) -> Iterator[tuple[int, int, int, int]]:
        if not rows:
            return
        rows.sort(key=lambda r: r[1:4])
        data = np.frombuffer(b"".join(r[4] for r in rows), kind)
        sizes = [len(r[4]) // data.itemsize for r in rows]
        bases = np.cumsum([0] + sizes)
        counts = [n - length + 1 for n in sizes]
        starts = np.concatenate([np.arange(b, b + c) for b, c in zip(bases, counts)])
        earlier, later = previous_factors(data, starts, length)
        hit = earlier if keep_first else earlier | later
        at = 0
        for (_, key, tag, lo, _), count in zip(rows, counts):
            for a, b in _runs(hit[at:at + count]):
                yield key, tag, lo + a, lo + b - 1 + length
            at += count

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tag", "start", "end"]
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("grp", "key", "tag", "lo", "bytes"))):
                if size > BATCH_BYTES and held[-1][0] != row[0]:
                    if found := list(solve(held)):
                        yield _batch(dict(zip(names, zip(*found))))
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held and (found := list(solve(held))):
            yield _batch(dict(zip(names, zip(*found))))
    return walk


def repeated_spans(docs: DataFrame, length: int = 400, keep_first: bool = True, limit: int = LIMIT,
                   words: int | None = None) -> DataFrame:
    """``key, tag, text, spans``: the byte spans of each text to remove.

    ``docs`` comes from :func:`common.keyed`. A span covers windows of
    ``length`` bytes that also start anywhere else; with ``keep_first`` the
    first copy, in the order of key and place, stays. With ``words`` there are
    also spans of windows of so many words, which count words from ``WORDS``
    on, and windows of bytes count only where they may hold fewer words.
    """
    if words is not None and words <= 2 * WORD_GRAM:
        raise ValueError("words must exceed 12")
    if length <= 2 * 32:
        raise ValueError("length must exceed 64 bytes")
    ranges = materialise(docs.select("key", "tag", "text").mapInArrow(_ranges(length, words), _RANGES), "ranges")
    place = F.struct("key", "tag", "lo", "hi")
    window = F.when(F.col("lo") < WORDS, F.lit(length)).otherwise(F.lit(words)) if words else F.lit(length)
    classes = ranges.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    shared = classes.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1")
    copied = classes.filter("n > 1").select(F.col("anchor").alias("anchor_"), F.col("content").alias("content_"),
                                            F.col("first").alias("first_"), "n")
    later = ~((F.col("key") == F.col("first_.key")) & (F.col("tag") == F.col("first_.tag"))
              & (F.col("lo") == F.col("first_.lo")))
    # A class with more than a thousandth of all ranges is broadcast (there are under a thousand), as its ranges
    # would meet in one task; the others are joined by their hashes.
    hot = ranges.count() // HOT_CLASSES + 1
    is_same = (F.col("anchor") == F.col("anchor_")) & (F.col("content") == F.col("content_"))
    marked = ranges.join(F.broadcast(copied.filter(F.col("n") > hot).drop("n")), is_same, "left")
    spread = marked.filter("first_ IS NOT NULL")
    rest = (marked.filter("first_ IS NULL").drop("anchor_", "content_", "first_")
            .join(copied.filter(F.col("n") <= hot).drop("n"), is_same))
    whole = (spread.unionByName(rest).filter(later if keep_first else F.lit(True))
             .select("key", "tag", F.col("lo").alias("start"), (F.col("hi") + window).alias("end")))

    texts = docs.repartition("key", "tag")
    wanted = (classes.join(shared, "anchor")
              .groupBy(F.col("first.key").alias("key_"), F.col("first.tag").alias("tag_"))
              .agg(F.collect_list(F.struct("anchor", "first.lo", "first.hi", "k")).alias("wanted")))
    same = (F.col("key") == F.col("key_")) & (F.col("tag") == F.col("tag_"))
    # All columns, needed or not: so this join and the last one read the same shuffle of the texts.
    one_each = texts.join(wanted, same).drop("key_", "tag_")
    spread = F.when(F.col("bytes").isNull(), F.xxhash64("key", "lo")).otherwise(F.col("grp"))
    contexts = (one_each.mapInArrow(_contexts(length, words, limit), _CONTEXTS)
                .withColumn("dealt", spread).repartition("dealt"))
    local = (contexts.filter("bytes IS NOT NULL").sortWithinPartitions("grp")
             .select("grp", "key", "tag", "lo", "bytes").mapInArrow(_local(length, words, keep_first), _SPANS))
    windows = contexts.filter("bytes IS NULL").select("grp", "sub", "key", "tag", "lo").distinct()
    often = (windows.groupBy("grp", "sub").agg(F.count("*").alias("n"), F.min(F.struct("key", "tag", "lo")).alias("first_"))
             .filter("n > 1").select(F.col("grp").alias("grp_"), F.col("sub").alias("sub_"), "first_"))
    single = (windows.join(often, (F.col("grp") == F.col("grp_")) & (F.col("sub") == F.col("sub_")))
              .filter(later if keep_first else F.lit(True))
              .select("key", "tag", F.col("lo").alias("start"), (F.col("lo") + window).alias("end")))
    found = (whole.unionByName(local).unionByName(single).groupBy(F.col("key").alias("key_"), F.col("tag").alias("tag_"))
             .agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    return texts.join(found, same, "left").drop("key_", "tag_")


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    merged: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def in_bytes(data: bytes, spans: list[dict]) -> list[dict]:
    """Spans of words as spans of bytes, with the white space after them; others stay."""
    if all(s["start"] < WORDS for s in spans):
        return spans
    starts, ends = word_places(data)
    edges = [*starts.tolist(), int(ends[-1])]
    return [s if s["start"] < WORDS else {"start": edges[s["start"] - WORDS], "end": edges[s["end"] - WORDS]} for s in spans]


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


_CUT = "key long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, tag, text, spans in zip(batch["key"].to_pylist(), batch["tag"].to_pylist(), batch["text"],
                                             batch["spans"].to_pylist()):
                data = text.as_buffer().to_pybytes()
                runs = merge_spans(spans)
                kept = cut_out(data, runs)
                rows.append((key, tag, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore").encode() if with_text else None))
            types = [_LONG] * 5 + [pa.string(), pa.binary()]
            names = ["key", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return apply


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   keep_first: bool = True, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    ``kept`` holds the remaining text as bytes; halves of a character at a
    cut are left out there, while ``kept_sha256`` is of the exact bytes. A
    null or empty text keeps nothing and removes nothing. Rows that repeat id
    and text count as copies of each other; with ``keep_first`` they count as
    one text and all stay. Other columns of ``df`` play no part.
    """
    spans = repeated_spans(keyed(df, id_col, text_col), length, keep_first, limit)
    return (spans.select("key", "tag", "text", "spans").mapInArrow(_cut(True), _CUT)
            .select(id_of().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
                    length: int = 400, limit: int = LIMIT, words: int | None = None) -> DataFrame:
    """``df`` with later copies of passages cut out of its texts.

    A passage has ``length`` bytes or more. With ``words`` it has so many words
    or more, parted by white space that need not be the same; where ``length``
    bytes may hold fewer words (long words, no white space), it is still one
    of ``length`` bytes.

    Columns and rows stay, also those with null or empty texts; ``chars_col``
    is set to the new length. Nothing else changes in untouched rows. Halves
    of a character at a cut are left out.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    docs = df.select(row_key(id_col).alias("key"), F.xxhash64(text_of(text_col)).alias("tag"),
                     text_of(text_col).alias("text"), rest.dropFields(f"`{text_col}`").alias("rest"),
                     F.col(text_col).isNull().alias("missing"))
    spans = repeated_spans(docs, length, True, limit, words)

    @F.pandas_udf("string")
    def kept_text(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, starts, ends):
            if a is None:
                out.append(None)
                continue
            data = t.encode()
            runs = merge_spans(in_bytes(data, [{"start": x, "end": y} for x, y in zip(a, b)]))
            out.append(cut_out(data, runs).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    # Only changed texts pass through Python.
    touched = F.when(F.col("spans").isNotNull(), F.col("text"))
    cut = spans.withColumn("kept", kept_text(touched, F.col("spans.start"), F.col("spans.end")))
    columns = [F.col(f"rest.`{c}`").alias(c) if c != text_col
               else F.when(~F.col("missing"), F.coalesce("kept", "text")).alias(c) for c in df.columns]
    if chars_col and chars_col in df.columns:
        kind = df.schema[chars_col].dataType
        columns[df.columns.index(chars_col)] = F.coalesce(F.char_length("kept").cast(kind), F.col(f"rest.`{chars_col}`")).alias(chars_col)
    return cut.select(*columns)


__all__ = ["LIMIT", "remove_repeats", "repeated_spans", "without_repeats"]
