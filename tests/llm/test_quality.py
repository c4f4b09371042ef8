"""Quality rules: counts against plain Python, the label model against planted truth."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logfault.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)


def texts():
    rng = random.Random(3)
    bits = ["a", "b", "cc", "é|", "##", "😀", " \t", "\n", "\n\n", "\x0b", "\x85", "\xa0x", "<b>"]
    out = [" ".join(rng.choice(bits[:rng.randint(2, 13)]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    line = " ".join(f"w{i}" for i in range(11))
    return out + ["", None, "\n \n", "\n".join([line] * 4), "x " * 8, "x " * 9, "x " * 3000, line + " " + line]


def test_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string").repartition(4)
    got = {r.doc_id: r for r in Q.judged(df).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.kept and r.base_failed)


def test_documents_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in Q.judged(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_keeps_clean_and_drops_junk(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.judged(docs).drop("quality").join(labels, "doc_id").filter(~F.col("base_failed")).groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_model_finds_the_accuracies():
    rng = random.Random(5)
    accuracy = [0.95, 0.8, 0.65, 0.9]
    counts, truth = Counter(), Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        pattern = tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < a) == good else -1) for a in accuracy)
        counts[pattern] += 1
        truth[pattern, good] += 1
    model = Q.fit(sorted(counts.items()), list("abcd"))
    assert model.prior == pytest.approx(0.7, abs=0.05)
    assert model.weights["a"][1] > model.weights["b"][1] > model.weights["c"][1] > 0
    assert all(model.weights[n][-1] < 0 for n in "abcd")


def test_repeats_empty_tables_and_partitions(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d " * 30)], "doc_id long, text string")
    assert Q.judged(docs).count() == 3
    assert Q.judged(docs.limit(0)).count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (Q.judged(table.repartition(n)).orderBy("doc_id").collect() for n in (1, 7))
    assert one == two
