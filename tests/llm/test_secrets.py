"""Secret scans against Python's regular expressions, and the ledger."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from logfault.llm import secrets as S
from logfault.llm.queries import op5_secrets

BASE = (
    ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def brute(text):
    spans = [(m.start(), i, m.end(), kind) for i, (kind, rx, good) in enumerate(BASE) for m in rx.finditer(text or "") if good(m)]
    return [(k, s, e) for s, _, e, k in sorted(spans)]


def texts():
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", "\"", "'", "AKIA", "ABCDEF0123456789",
            "0123456789abcdef" * 2, "é", "\n", "x", "ab", "\U0001f600", "=secret: abcdefghij", "\tz", "K"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return out + ["", None, "AKIA" * 9, "token=secret: abcdefgh", "f" * 70, "é" * 50 + "password = 'abc-def/ghi'",
                  "toKen=abcdefgh", "a" * 40 + " " + ("b" * 33 + " ") * 500]


def test_spans(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.secrets(df)[0].collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in op5_secrets(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans = brute(r.text)
        counts = Counter(k for k, _, _ in spans)
        assert got[r.doc_id] == (counts["assign"], counts["access"], counts["hex"], ",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([(1, "password=abcdefgh"), (2, "plain"), (3, "plain")], "doc_id long, text string")
    found, ledger = S.secrets(one, rules=S.RULES[:2])
    assert ledger.count() == 2
    assert {tuple(len(e.spans) for e in r.entries) for r in ledger.collect()} == {(1, 0), (0, 0)}
    again, added = S.secrets(one, rules=S.RULES[:2], ledger=ledger)
    assert added.count() == 0
    assert sorted(found.collect()) == sorted(again.collect())
    more = one.union(spark.createDataFrame([(4, "f" * 32), (None, "password=abcdefgh")], "doc_id long, text string"))
    found, added = S.secrets(more, ledger=ledger)
    entries = {len(r.entries) for r in added.collect()}
    assert added.count() == 3 and entries == {1, 3}  # the new rule on old blobs, all rules on the new one
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {1: 1, 2: 0, 3: 0, 4: 1, None: 1}


def test_redaction(spark):
    rows = [(i, t, -1, "k") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, blob string")
    out = S.without_secrets(df)
    assert out.schema == df.schema
    left = out.withColumn("same", F.col("n_chars") == -1).collect()
    assert len(left) == len(rows)
    for r in left:
        text = rows[r.doc_id][1]
        assert brute(r.text) == []
        assert r.same == (not brute(text))
        assert r.text == text if r.same else r.n_chars == len(r.text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.secrets(df)[0].count() == 0
    assert S.without_secrets(df).count() == 0


def test_running_sums(spark):
    for values in ([], [5], list(range(1500))):
        df = spark.createDataFrame([(values,)], "v array<long>")
        got = df.select(S.running_sums(F.col("v"), 64).alias("s")).first().s
        assert got == [sum(values[:i + 1]) for i in range(len(values))]
