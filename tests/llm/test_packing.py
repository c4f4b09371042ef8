"""Token pieces and packing against the tokenizer itself and lower bounds."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logfault.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
    return [np.array([*e.ids, 0], "<u4") for e in found]


def texts():
    rng = random.Random(6)
    bits = ["the", "The,", " ", "\n", "  ", "\t", "don't", "x'll", "é", "　", "\xa0", "!!", "123", "<|endoftext|>", "\r\n", "\0",
            "日本", "😀", "_a", "\x1c"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", " ", "\n", " a", "a ", "a\n", "\na b"]


def test_parts_encode_as_the_whole():
    encoder = P.Encoder(VOCABULARY, remembered=50)
    assert [encoder(t) for t in texts()] == [i[:-1].tobytes() for i in ids_of(texts())]


def test_fast_parts_agree(spark):
    fast = P.part_encoder(VOCABULARY)
    words = {w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() for w in r.text.split(" ")}
    some = [w for w in [*words, *texts()] if "<|" not in w]
    assert [fast(w) for w in some] == [i[:-1].tolist() for i in ids_of(some)]


def test_packing_is_tight_and_legal():
    rng = np.random.default_rng(3)
    sizes = np.sort(np.r_[rng.integers(1, 2049, 3000), np.full(200, 2048), rng.integers(1, 200, 2000)])[::-1]
    to, at = P.sum_of_squares(sizes)
    for b in range(to.max() + 1):
        places = sorted(zip(at[to == b], sizes[to == b]))
        assert [p for p, _ in places] == [sum(s for _, s in places[:i]) for i in range(len(places))]
        assert sum(s for _, s in places) <= 2048
    assert to.max() + 1 <= -(-sizes.sum() // 2048) + 2


def test_square_rule():
    # Gaps 40, 40, 60 are open; size 20 leaves gaps 20, 40, 60 rather than 40, 40, 40.
    to, _ = P.sum_of_squares(np.array([60, 60, 40, 20]), 100)
    assert to[3] in (0, 1)


def test_rows_of_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(900, long, 1), (901, None, 2), (900, long, 1), (None, "x y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(6)
    out = P.pack(df, VOCABULARY, group=150).collect()
    want = Counter()
    for (i, t, _), ids in zip(rows, ids_of([t or "" for _, t, _ in rows])):
        n, start, piece = len(ids), 0, 0
        while start < n:
            size = (n % 2048 or 2048) if start == 0 else 2048
            want[(i, piece, start, size, zlib.crc32(ids[start:start + size].tobytes()))] += 1
            start, piece = start + size, piece + 1
    assert Counter(tuple(r)[:5] for r in out) == want
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 2048


def test_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.pack(docs, VOCABULARY).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert got.s <= -(-got.n // 2048) + 2


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_repeated_rows_spread_over_groups(spark):
    """Equal rows must not all meet in one group."""
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    packed = P.pack(rows, VOCABULARY, group=500)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 650 and sum(sizes) == 6000
