"""The pipeline, stage by stage, against brute-force versions of its stages."""

import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from logfault.llm import packing, toxicity  # noqa: E402
from logfault.sources.scratch import materialise  # noqa: E402
from tests.llm.test_near_copies import brute_groups  # noqa: E402
from tests.llm.test_secrets import brute as brute_secrets  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), f"test-{name}")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "secrets", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_toxicity(spark, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    at, w = toxicity.train(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    dense = np.zeros(1 << toxicity.BITS)
    dense[at] = w
    assert set(after) == {i for i, r in before.items() if toxicity.score_of(r.text, dense) < 0.5}
    assert all(after[i] == before[i] for i in after)


def test_simhash(stages):
    """One text of each group of near copies stays (all are found on this small table)."""
    before, after = by_id(stages[1]), by_id(stages[2])
    group, _ = brute_groups({i: r.text for i, r in before.items()})
    assert set(after) == set(group.values())
    assert all(after[i] == before[i] for i in after)


def brute_cut(texts, length, words):
    """Later copies of windows of ``words`` words go, and of windows of ``length`` bytes that may hold fewer words."""
    pieces = {k: list(re.finditer(rb"[^ \t-\r]+", t)) for k, t in texts.items()}
    gone = {k: bytearray(len(t)) for k, t in texts.items()}
    seen = set()
    for k in sorted(texts):
        found = [m.group() for m in pieces[k]]
        edges = [m.start() for m in pieces[k]] + [m.end() for m in pieces[k][-1:]]
        for i in range(len(found) - words + 1):
            window = tuple(found[i:i + words])
            if window in seen:
                gone[k][edges[i]:edges[i + words]] = b"\1" * (edges[i + words] - edges[i])
            seen.add(window)
    seen = set()
    for k in sorted(texts):
        for i in range(len(texts[k]) - length + 1):
            window = texts[k][i:i + length]
            if len(window.split()) >= words + 2:
                continue
            if window in seen:
                gone[k][i:i + length] = b"\1" * length
            seen.add(window)
    return {k: bytes(b for b, g in zip(texts[k], gone[k]) if not g).decode("utf-8", "ignore") for k in texts}


def test_suffix_dedup(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    want = brute_cut({i: r.text.encode() for i, r in before.items()}, 400, corpus_pipeline.PASSAGE_WORDS)
    assert {i: r.text for i, r in after.items()} == want
    assert any(want[i] != before[i].text for i in want)
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_suffix_dedup_of_planted_passages(spark):
    """51 words go, 50 stay; 400 bytes without white space go, whatever stands before them."""
    words = [f"{'abcd' if i % 2 else 'w'}{i}" for i in range(51)]
    block = "".join(chr(97 + i * i % 23) + chr(97 + i % 26) for i in range(250))
    rows = [(1, "first " + " ".join(words) + " end"), (2, "other  " + "\n".join(words) + " rest"), (3, "and " + " ".join(words[1:]) + " so"),
            (4, "x" + block + "y"), (5, "head " + "z" * 70 + block), (6, block[:399]), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup_stage(spark, docs, FOLDER).collect()}
    assert got == {**brute_cut({i: (t or "").encode() for i, t in rows}, 400, 51), 7: None}
    assert got[2] == "other  rest" and got[3] == rows[2][1] and got[5] == "head " + "z" * 70 and got[6] == block[:399]


def test_secrets(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert brute_secrets(r.text) == []
        assert r.text == before[i].text or brute_secrets(before[i].text)


def test_packing(stages):
    from tests.llm.test_packing import ids_of
    texts = by_id(stages[4])
    pieces = {}
    for r in stages[5].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for (i, r), ids in zip(texts.items(), ids_of([r.text for r in texts.values()])):
        own = sorted(pieces[i], key=lambda p: p.piece)
        assert sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in own)
    used = {}
    for own in pieces.values():
        for p in own:
            used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
    assert max(used.values()) <= packing.LENGTH


def test_run(spark, stages):
    from logfault.sources import scratch
    before = scratch.scratch_mark()
    assert corpus_pipeline.run(spark, FOLDER).count() == stages[5].count()
    assert scratch.scratch_mark() == before + 1  # nothing but the result is left


def test_scratch_of_earlier_stages_goes(spark, tmp_path):
    """Also where the stages are not run by ``run``; what a result that nobody has written still reads stays."""
    from pathlib import Path as P
    there = lambda paths: [p for p in paths if P(p.removeprefix("file:")).is_dir()]
    from logfault.sources import scratch
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mark = scratch.scratch_mark()
    corpus_pipeline.simhash_stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/1")
    first = there(scratch.scratch_since(mark))
    assert len(first) == 1  # the ids that stay
    mark = scratch.scratch_mark()
    second = corpus_pipeline.suffix_dedup_stage(spark, spark.read.parquet(f"{tmp_path}/1"), FOLDER)
    assert not there(first)
    third = corpus_pipeline.secrets_stage(spark, second, FOLDER)  # the second is not written yet
    assert third.count() == spark.read.parquet(f"{tmp_path}/1").count()
