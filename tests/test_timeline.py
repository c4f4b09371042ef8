import random

import pytest
from pyspark.sql import functions as F

from logfault.functions import tail_features as TF
from logfault.operators import timeline as TL

START = 1_700_000_000


def _logs(spark, rows):
    """rows: (sn, second offset, micros, row_id)"""
    df = spark.createDataFrame(rows, "sn string, s int, us int, row_id bigint")
    return df.select("sn", F.timestamp_micros((F.lit(START).cast("bigint") + F.col("s")) * 1_000_000 + F.col("us")).alias("time"),
                     (F.lit(START).cast("bigint") + F.col("s")).alias("time_ts"), "row_id")


def _faults(spark, rows):
    df = spark.createDataFrame(rows, "fault_id bigint, sn string, s int")
    return df.select("fault_id", "sn", (F.lit(START).cast("bigint") + F.col("s")).alias("fault_ts"))


def _random(seed, n_logs=400, n_faults=60):
    rng = random.Random(seed)
    # One server holds most rows, and many of them fall in one second.
    def sn():
        return "hot" if rng.random() < 0.6 else f"s{rng.randrange(5)}"
    logs = [(sn(), 500 if rng.random() < 0.3 else rng.randrange(1000), rng.randrange(3), i) for i in range(n_logs)]
    faults = [(i, "none" if i == 0 else sn(), rng.choice([0, 499, 500, 501, rng.randrange(1100)]))
              for i in range(n_faults)]
    return logs, faults


def _brute(logs, fault, n):
    rows = sorted([r for r in logs if r[0] == fault[1] and r[1] <= fault[2]], key=lambda r: (r[1], r[2], r[3]))
    return len(rows), [r[3] for r in rows[-n:]]


@pytest.mark.parametrize("seed,slot,broadcast,partitions", [(1, 64, 10**6, 4), (2, 7, 0, 1), (3, 1 << 19, 0, 16)])
def test_tails_equal_brute_force(spark, seed, slot, broadcast, partitions):
    logs, faults = _random(seed)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in (1, 5, 20, 50):
            got = TL.tail_arrays(_logs(spark, logs).repartition(partitions), _faults(spark, faults), n, [],
                                 prefilter=n == 5, slot_seconds=slot, max_broadcast=broadcast)
            rows = {r["fault_id"]: (r["pos"], [x["row_id"] for x in r["tail"]]) for r in got.collect()}
            assert len(rows) == len(faults)
            for fault in faults:
                pos, ids = _brute(logs, fault, n)
                assert rows[fault[0]][1] == ids
                if n == 5:
                    continue
                assert rows[fault[0]][0] == pos
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("seed", [4, 5])
def test_windows_and_look_ahead(spark, seed):
    logs, faults = _random(seed)
    L, Fa = _logs(spark, logs), _faults(spark, faults)
    got = {r["fault_id"]: r for r in TL.window_totals(L, Fa, {"w": 50}, {"ids": F.col("row_id")}, slot_seconds=16).collect()}
    ahead = {r["fault_id"]: r for r in TL.look_ahead(L, Fa, slot_seconds=16).collect()}
    for fid, sn, s in faults:
        mine = [r for r in logs if r[0] == sn and s - 50 <= r[1] <= s]
        assert got[fid]["w_n"] == len(mine)
        assert got[fid]["w_ids"] == sum(r[3] for r in mine)
        later = [r[1] for r in logs if r[0] == sn and r[1] >= s]
        assert ahead[fid]["post_cnt"] == len(later)
        assert ahead[fid]["post_span"] == (min(later) - s if later else 0)


def test_tail_by_arrival(spark):
    logs, faults = _random(6)
    logs = [(a, b, c, (i * 7919) % 10007) for a, b, c, i in logs]
    rows = TL.tail_by_arrival(_logs(spark, logs), _faults(spark, faults), 10, []).collect()
    got = {}
    for r in rows:
        got.setdefault(r["fault_id"], set()).add(r["row_id"])
    for fid, sn, s in faults:
        want = sorted((r[3] for r in logs if r[0] == sn and r[1] <= s), reverse=True)[:10]
        assert got.get(fid, set()) == set(want)


def test_tail_by_arrival_payload(spark, monkeypatch):
    """The payload is that of its row, in order of arrival, for any number of sizes made at once."""
    logs, faults = _random(8)
    logs = [(a, b * 40, c, (i * 7919) % 10007) for a, b, c, i in logs]
    faults = [(f, sn, s * 40) for f, sn, s in faults]
    table = _logs(spark, logs).withColumn("word", F.concat(F.lit("w"), F.col("row_id").cast("string")))
    want = {}
    for fid, sn, s in faults:
        newest = sorted((r[3] for r in logs if r[0] == sn and r[1] <= s), reverse=True)[:10]
        want |= {(fid, back + 1): f"w{row}" for back, row in enumerate(newest)}
    for at_once in (1, 6, 20):
        monkeypatch.setattr(TL, "LEVELS_AT_ONCE", at_once)
        rows = TL.tail_by_arrival(table, _faults(spark, faults), 10, ["word"])
        assert rows.columns[-3:] == ["row_id", "word", "back"]
        assert {(r["fault_id"], r["back"]): r["word"] for r in rows.collect()} == want


def test_borders(spark):
    """Same second kept, one second later dropped; 24 h inclusive."""
    logs = _logs(spark, [("a", 10, 900_000, 1), ("a", 11, 0, 2)])
    faults = _faults(spark, [(1, "a", 10), (2, "a", 9), (3, "b", 10)])
    tails = {r["fault_id"]: [x["row_id"] for x in r["tail"]] for r in TL.tail_arrays(logs, faults, 20, []).collect()}
    assert tails == {1: [1], 2: [], 3: []}
    crash = _logs(spark, [("a", 0, 0, 1)])
    late = _faults(spark, [(1, "a", 86_400), (2, "a", 86_401)])
    counts = {r["fault_id"]: r["c"] for r in TL.recent_count(crash, late, 86_400, "c").collect()}
    assert counts == {1: 1, 2: 0}


def test_no_range_join_or_python(spark):
    logs, faults = _random(7)
    df = TL.tail_arrays(_logs(spark, logs), _faults(spark, faults), 20, [])
    df = df.withColumn("gap", TF.gaps("tail")).select("fault_id", *TF.gap_series("gap"))
    for frame in (df, TL.window_totals(_logs(spark, logs), _faults(spark, faults), {"w": 9})):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for word in ("CartesianProduct", "NestedLoop", "Python", "Pandas"):
            assert word not in plan


def test_rounded_seconds_give_the_same_tails(spark):
    from pyspark.sql import functions as F
    from logfault.operators import timeline as TL
    logs = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("sn"), (F.col("id") * 977 % 900_000).alias("time_ts"),
                                    F.col("id").alias("row_id")).withColumn("time", F.timestamp_seconds("time_ts"))
    faults = logs.filter("row_id % 10 = 0").select(F.col("row_id").alias("fault_id"), "sn", F.col("time_ts").alias("fault_ts"))

    def tails(most):
        found = TL.tail_arrays(logs, faults, 3, [], max_broadcast=most)
        return {r.fault_id: (r.pos, [t.row_id for t in r.tail]) for r in found.collect()}
    want = tails(1_000_000)
    # Bounds that fit seconds, minutes, hours, days, and none of them.
    assert all(tails(most) == want for most in (400, 100, 12, 0))


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    from logfault.sources import scratch
    from logfault.sources.scratch import drop_scratch, materialise
    scratch._written.clear()
    df = materialise(spark.range(5), "numbers")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os
    assert df.count() == 5 and os.path.isdir(path)
    assert drop_scratch(spark) == 1 and not os.path.isdir(path)
