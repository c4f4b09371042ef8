"""Base patterns against the plain expressions, the field against enumeration and held-out writings."""

import itertools
import math
import random
import re

import pytest

from logfault.llm import personal_data as P
from logfault.llm.queries import op3_personal_data

PLAIN = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda t: all(int(p) <= 255 for p in t.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda t: 12 <= len(re.sub(r"\D", "", t)) <= 19 and P.luhn(re.sub(r"\D", "", t))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: 9 <= len(re.sub(r"\D", "", t)) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (rx, good) in enumerate(PLAIN) for m in rx.finditer(text) if good(m[0]))


def odd_texts():
    rng = random.Random(7)
    bits = ["a", "b.c", "@", "x@y.z", ".", "-", "10.0.0.1", "256.1.1.1", "4111111111111111", " ", "+1 (212) 555-0100", "1", "22", "é",
            "٣", "\n", "%", "4111 1111 1111 1111", "+", "(5)"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", "1" * 3000, "a" * 500 + "@", "@" * 50]


def test_base_patterns():
    for text in odd_texts():
        assert P.base_spans(text) == brute(text), text


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    texts = []
    for i in range(400):
        d = [rng.randint(0, 9) for _ in range(15)]
        card = next(c for n in range(10) if P.luhn(c := "4" + "".join(map(str, d[1:])) + str(n)))
        pick = [f"ab{i}.c@mail{i % 7}.example.com", f"{rng.randint(1, 255)}.{i % 256}.7.{rng.randint(0, 255)}", card,
                f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "token = " + f"{rng.getrandbits(160):040x}", "version 4.0.12"]
        texts.append(" ".join(["some words go here", pick[i % 6], "and then more words."]))
    return P.train(texts)


@pytest.mark.parametrize("text, kind, span", [
    ("please call (212) 555-0199 before noon", "phone", "(212) 555-0199"),
    ("or dial 212-555-0199, she said", "phone", "212-555-0199"),
    ("paid by 4111.1111.1111.1111 today", "card", "4111.1111.1111.1111"),
    ("from 10.20.30.40 4111111111111111 it came", "card", "4111111111111111"),
])
def test_looser_writings(field, text, kind, span):
    found = [(P.KINDS[k], text[a:b]) for a, k, b in P.added_spans(text, P.base_spans(text), field)]
    assert found == [(kind, span)]


@pytest.mark.parametrize("text", ["order 123456 of 2020-01-02 for 300.500", "host 10.20.300.400 is down", "paid 4111.1111.1111.1112 now",
                                  "meet at 10.30 at home", "version 4.0.12 of the license", "", "no numbers at all"])
def test_leaves_others_alone(field, text):
    assert P.added_spans(text, P.base_spans(text), field) == []


def test_dynamic_programs_against_enumeration():
    rng, field = random.Random(3), P.Field()
    size = 5
    scores = {(i, j): [rng.uniform(-2, 2) for _ in P.KINDS] for i in range(size) for j in range(i + 1, size + 1) if j - i <= 3}

    def ways(at):
        if at == size:
            yield ()
            return
        yield from ways(at + 1)
        for (i, j), by_kind in scores.items():
            if i == at:
                yield from (((i, j, k), *rest) for k in range(len(by_kind)) for rest in ways(j))
    every = list(ways(0))
    value = lambda way: sum(scores[i, j][k] for i, j, k in way)
    assert tuple(field.best(size, scores)) == max(every, key=value)
    total = sum(math.exp(value(w)) for w in every)
    marginals = field.marginals(size, scores)
    for span in itertools.islice(marginals, 0, None, 5):
        assert marginals[span] == pytest.approx(sum(math.exp(value(w)) for w in every if span in w) / total)


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op3_personal_data(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        base = brute(r.text)
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        spans = g.spans.split(",") if g.spans else []
        assert {f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(spans)


def test_odd_rows(spark):
    rows = [(1, "a@b.cc x", "q"), (1, "a@b.cc x", "q"), (2, None, "r"), (None, "1.2.3.4", "s"), (3, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = sorted(((r.doc_id, r.spans) for r in P.personal_data(df, P.fit(df)).collect()), key=str)
    assert got == sorted([(1, "email:0:6"), (1, "email:0:6"), (2, ""), (None, "ip:0:7"), (3, "")], key=str)
    assert P.personal_data(df.limit(0), P.fit(df.limit(0))).count() == 0
