from logfault.operators import profiles as P


def test_attach_model(spark):
    """No model and no log at all give the mark, two models double the fault, repeated logs do not."""
    faults = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "none"), (5, None)], "fault_id long, sn string")
    logs = spark.createDataFrame([("a", "m1")] * 3 + [("b", "m1"), ("b", "m2"), ("c", None), (None, "m9")],
                                 "sn string, server_model string")
    got = sorted((r["fault_id"], r["server_model"]) for r in P.attach_model(faults, logs).collect())
    assert got == [(1, "m1"), (2, "m1"), (2, "m2"), (3, "MISSING"), (4, "MISSING"), (5, "MISSING")]
    assert P.attach_model(faults.limit(0), logs).count() == 0
