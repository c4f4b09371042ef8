"""Merge replay against the reference tokenizer library and a plain loop."""

import base64
import hashlib
import random

import pytest

from logfault.llm import byte_bpe as B

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(8)
    bits = ["the", "The,", " ", "\n", "  ", "\t", "don't", "x'll", "é", "　", "\xa0", "!!", "123", "<|endoftext|>", "\r\n", "\0",
            "日本", "😀", "_a", "\x1c", "aaaa", "ababab", "====", "ing", "tion"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", "a" * 3000, "ab" * 900, "\n" * 50]


def test_same_ids_as_the_library(spark, library):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    every = docs + texts()
    encoder = B.Encoder(PATH, remembered=1000)
    got = [x for some in B._batches(every) for x in encoder.encode(some)]
    assert [ids.tolist() for ids, _ in got] == [library.encode_ordinary(t) for t in every]
    assert all(text == b" ".join(b"%d" % i for i in ids) for ids, text in got)
    assert all(encoder.vocabulary.decode(ids.tolist()) == t.encode() for (ids, _), t in zip(got, every))


def greedy(word, vocabulary):
    """Lowest rank first, leftmost of equals."""
    parts = [bytes([b]) for b in word]
    while True:
        ranked = [(vocabulary.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        ranked = [r for r in ranked if r[0] is not None]
        if not ranked:
            return [vocabulary.ranks[p] for p in parts]
        _, i = min(ranked)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_that_fall_after_a_merge(tmp_path):
    # Random vocabularies: joining two tokens may give one of lower rank, which must then come first.
    rng = random.Random(1)
    for trial in range(60):
        tokens = [bytes([i]) for i in range(256)]
        extra = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(40)}
        order = sorted(extra)
        rng.shuffle(order)
        path = tmp_path / f"{trial}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens + order)))
        vocabulary = B.Vocabulary(str(path))
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14))) for _ in range(200)]
        assert [ids.tolist() for ids in B.replay(words, vocabulary)] == [greedy(w, vocabulary) for w in words]


def test_rows(spark, library):
    rows = [(1, "hello  world", "x"), (1, "hello  world", "x"), (2, None, "y"), (None, "a b", "z"), (3, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = B.encoded(df, PATH)
    got = sorted(out.collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.text for r in B.decoded(out, PATH).collect()} == {"hello  world", "", "a b"}
    assert B.encoded(df.limit(0), PATH).count() == 0
