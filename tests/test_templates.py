import random

from pyspark.sql import functions as F

from logfault.functions.cleaning import WILDCARD
from logfault.operators import templates as T
from logfault.operators.lookup import lookup


def _log(spark, seed=1, n=600):
    rng = random.Random(seed)
    parts = ["boot", "link", "disk", "fan"]
    rows = [(i, f"{rng.choice(parts)} state {rng.choice(['up', 'down', 'lost'])} port {rng.randrange(50)} "
                f"{rng.choice(['ok', 'bad'])}" + (" again" if rng.random() < 0.3 else "")) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, msg_lower string")


def _dictionary(templates):
    return {(r["template_id"], r["template"], r["size"]) for r in templates.collect()}


def test_every_message_matches(spark):
    log = _log(spark)
    templates = T.mine_templates(log)
    assert templates.agg(F.sum("size")).first()[0] == 600
    attached = T.attach_templates(log, templates)
    assert attached.count() == 600
    assert attached.filter(F.col("template_id") == "None").count() == 0
    for row in attached.limit(50).collect():
        assert len(row["template"].split()) == len(row["msg_lower"].split())


def test_same_result_for_any_partitioning(spark):
    log = _log(spark)
    assert _dictionary(T.mine_templates(log.repartition(1))) == _dictionary(T.mine_templates(log.repartition(16)))


def _hot(n=600):
    names = [chr(97 + a) + chr(97 + b) for a in range(26) for b in range(26)]
    return [(i, f"job {names[i]} on host {names[(7 * i) % 600]} of {names[i % 5]} {names[i % 11]}") for i in range(n)]


def test_one_rule_for_hot_routes(spark):
    log = spark.createDataFrame(_hot(), "row_id bigint, msg_lower string")
    one, many = (_dictionary(T.mine_templates(log.repartition(n))) for n in (1, 16))
    assert one == many and sum(size for _, _, size in one) == 600
    assert T.attach_templates(log, T.mine_templates(log)).filter(F.col("template_id") == "None").count() == 0


def test_known_template_grows_in_a_hot_route(spark):
    log = spark.createDataFrame(_hot(), "row_id bigint, msg_lower string")
    known = spark.createDataFrame([(61, ["job", "up", "on", "host", WILDCARD], 5, 0)],
                                  "template_id bigint, tokens array<string>, size bigint, first_row bigint")
    more = log.unionByName(spark.createDataFrame([(9000, "job up on host cb")], "row_id bigint, msg_lower string"))
    got = {r.template_id: r for r in T.mine_templates(more, known=known).collect()}
    assert got[61].size == 6 and got[61].template == f"job up on host {WILDCARD}"
    assert min(i for i in got if i != 61) == 62


def test_threshold_ties_and_order(spark):
    rows = [(1, "a b c d e"), (2, "a b x y z"),   # 2 of 5 equal: joins at 0.4
            (3, "q w e r t"), (4, "q p o i u"),   # 1 of 5 equal: stays apart
            (5, "m n o p q"), (6, "m 1 r s t"),
            (7, "m n o s t")]                     # 3 of 5 with each of two: the older one
    log = spark.createDataFrame(rows, "row_id bigint, msg_lower string")
    w = WILDCARD
    got = {r.template: r.size for r in T.mine_templates(log).collect()}
    assert got[f"a b {w} {w} {w}"] == 2
    assert "q w e r t" in got and "q p o i u" in got
    assert got[f"m n o {w} {w}"] == 2


def test_deeper_prefix_is_narrower(spark):
    rows = [(i, f"a {'bc'[i % 2]} same same {i % 3}x") for i in range(12)]
    log = spark.createDataFrame(rows, "row_id bigint, msg_lower string")
    assert T.mine_templates(log).count() == 1
    assert T.mine_templates(log, prefix_depth=2).count() == 2


def test_unlike_messages_stay_apart(spark):
    rows = [(i, f"a {'bcdefgh'[i]} {'ijklmno'[i]} {'pqrstuv'[i]}") for i in range(7)]
    log = spark.createDataFrame(rows, "row_id bigint, msg_lower string")
    assert T.mine_templates(log).count() == 7


def test_state_goes_on_growing(spark, tmp_path):
    log = _log(spark)
    path = str(tmp_path / "templates")
    T.save_templates(T.mine_templates(log), path)
    known = T.load_templates(spark, path)
    again = T.mine_templates(log, known=known)
    ids = {r["template_id"] for r in known.collect()}
    assert {r["template_id"] for r in again.collect()} == ids
    assert again.agg(F.sum("size")).first()[0] == 1200


def test_fewest_wildcards_win(spark):
    table = spark.createDataFrame(
        [(1, f"a {WILDCARD} {WILDCARD}", ["a", WILDCARD, WILDCARD], 3), (2, f"a b {WILDCARD}", ["a", "b", WILDCARD], 3)],
        "template_id bigint, template string, tokens array<string>, n_tokens int")
    log = spark.createDataFrame([(1, "a b c"), (2, "a x c"), (3, "z x c")], "row_id bigint, msg_lower string")
    got = {r["row_id"]: r["template_id"] for r in T.attach_templates(log, table).collect()}
    assert got == {1: "2", 2: "1", 3: "None"}


def test_lookup_with_hot_keys(spark):
    facts = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 700, "hot")
                                     .when(F.col("id") < 990, F.concat(F.lit("k"), F.col("id") % 5)).alias("key"))
    table = facts.filter("key <> 'k3'").groupBy("key").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("value", F.upper("key"))
    got = lookup(facts, table, "key", ["value"], weight="n", hot_rows=100)
    assert got.count() == 1000
    assert got.filter("value IS NULL").count() == facts.filter("key IS NULL OR key = 'k3'").count()
    assert got.filter("value <> upper(key)").count() == 0


def _stream_of(items, known=(), similarity=T.SIMILARITY):
    """Plain mining of one long stream per route: (template, size) pairs."""
    routes = {}
    for tokens, size, first in sorted(items, key=lambda x: (x[2], x[0])):
        routes.setdefault((len(tokens), WILDCARD if any(c.isdigit() for c in tokens[0]) else tokens[0]), []).append((tokens, size))
    out = {}
    for route, messages in routes.items():
        grown = [[list(k), n] for k, n in known if (len(k), k[0]) == route]
        for tokens, size in messages:
            scored = [(sum(a == b and a != WILDCARD for a, b in zip(t, tokens)), t.count(WILDCARD), -i) for i, (t, _) in enumerate(grown)]
            top = max(scored, default=(-1, 0, 0))
            if top[0] >= similarity * len(tokens):
                best = grown[-top[2]]
                best[0] = [a if a == b else WILDCARD for a, b in zip(best[0], tokens)]
                best[1] += size
            else:
                grown.append([list(tokens), size])
        for t, n in grown:
            out[" ".join(t)] = out.get(" ".join(t), 0) + n
    return out


def _random_log(seed, n):
    """Messages of nested shapes, so that templates grow and draw messages from each other."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        shape = rng.choice(["hot {} is {} on {} of {} {}", "hot {} was {} on {} of {} {}", "hot {} {} {} {} {} {}", "cold {} {} {}", "one {}"])
        rows.append((rng.randrange(10 * n), shape.format(*("".join(rng.choices("abcdef", k=rng.choice((1, 1, 2)))) for _ in range(6)))))
    return rows


def test_rounds_equal_one_stream(spark):
    """Any cut of the work gives the templates of one long stream, also with known templates and repeated row ids."""
    for seed in (1, 2):
        rows = _random_log(seed, 1500)
        known = spark.createDataFrame([(7, ["hot", "a", "is", WILDCARD, "on", "b", "of", "c", "d"], 5, 0)],
                                      "template_id bigint, tokens array<string>, size bigint, first_row bigint") if seed == 2 else None
        log = spark.createDataFrame(rows, "row_id bigint, msg_lower string")
        items = {}
        for i, m in rows:
            size, first = items.get(tuple(m.split()), (0, i))
            items[tuple(m.split())] = size + 1, min(first, i)
        want = _stream_of([(list(k), *v) for k, v in items.items()], [(k.tokens, k.size) for k in known.collect()] if known else ())
        for parts, first_rows, slice_rows in ((1, 10_000, 10_000), (16, 8, 40), (3, 64, 200)):
            got = T.mine_templates(log.repartition(parts), known=known, first_rows=first_rows, slice_rows=slice_rows)
            assert {r.template: r.size for r in got.collect()} == want


def test_a_hot_route_is_many_tasks(spark):
    """A third of all messages share their route: they are compared in slices, few of them go through the stream."""
    names = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    rows = [(i, f"job {names[i % 160]} on {names[i // 160 % 160]} now") for i in range(4000)] + [
        (10_000 + i, f"{names[i % 160]} {' '.join(names[j] for j in range(i // 160))} x{names[i // 160]}") for i in range(8000)]
    log = spark.createDataFrame(rows, "row_id bigint, msg_lower string")
    seen = []
    kept, T._stream = T._stream, lambda chosen, s: seen.append(chosen.filter("route LIKE '%job'").count()) or kept(chosen, s)
    try:
        got = T.mine_templates(log, first_rows=50, slice_rows=500)
    finally:
        T._stream = kept
    assert {r.template: r.size for r in got.filter("first_token = 'job'").collect()} == {f"job {WILDCARD} on {WILDCARD} now": 4000}
    assert max(seen) <= 800  # a fifth of them
    routed = log.select(F.lit("5 job").alias("route"), T.template_tokens("msg_lower").alias("tokens")).filter("size(tokens) = 5 AND tokens[0] = 'job'")
    slices = T._in_slices(routed, T._busy_routes(routed, 50, 500)).groupBy("slice").count().collect()
    assert len(slices) == 8 and max(r["count"] for r in slices) < 700
