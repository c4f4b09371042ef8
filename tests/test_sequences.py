import math

import pytest
from pyspark.sql import functions as F

from logfault.functions import tail_features as TF


def _tail(spark, ids):
    df = spark.createDataFrame([(ids,)], "ids array<bigint>")
    return df.withColumn("tail", F.transform("ids", lambda x: F.struct(x.alias("msg_id"))))


@pytest.mark.parametrize("ids,reference,strict", [
    ([1, 2, 3], ("3", 0), ("1", 1)), ([1, 1, 2], ("2", 2), ("1", 2)),
    ([2, 2, 2, 1, 1], ("1", 3), ("2", 3)), ([], ("NULL", 0), ("NULL", 0))])
def test_longest_run(spark, ids, reference, strict):
    df = _tail(spark, ids)
    assert tuple(df.select(*TF.longest_run("tail")).first()) == reference
    assert tuple(df.select(*TF.longest_run("tail", "strict")).first()) == strict


def test_gap_series(spark):
    df = spark.createDataFrame([([2, 4, 4, 10],)], "gap array<bigint>")
    row = df.select(*TF.gap_series("gap")).first()
    assert row.abs_energy == 136
    assert row.count_above == 0.0
    assert row.count_above_mean == 1
    assert row.mean_abs_change == pytest.approx(8 / 3)
    assert row.mean_change == pytest.approx(8 / 3)
    assert row.percentage_of_reoccurring_datapoints_to_all_datapoints == 0.5
    assert row.percentage_of_reoccurring_values_to_all_values == pytest.approx(1 / 3)
    shares = [1 / 4, 1 / 4, 0, 1 / 2, 0, 0, 0, 0, 0]
    law = [math.log10(1 + 1 / d) for d in range(1, 10)]
    ms, ml = sum(shares) / 9, sum(law) / 9
    cov = sum((a - ms) * (b - ml) for a, b in zip(shares, law))
    want = cov / math.sqrt(sum((a - ms) ** 2 for a in shares) * sum((b - ml) ** 2 for b in law))
    assert row.benford_correlation == pytest.approx(want)


def test_gap_series_without_gaps(spark):
    df = spark.createDataFrame([([],), ([5],)], "gap array<bigint>")
    empty, one = df.select(*TF.gap_series("gap"), *TF.gap_features("gap")).collect()
    assert all(v is None for v in empty)
    assert one.mean_change is None and one.sample_entropy is None and one.abs_energy == 25


def test_sample_entropy(spark):
    x = [1, 2, 1, 2, 1, 2, 1, 2, 9, 1, 2]
    mean = sum(x) / len(x)
    tol = 0.2 * math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))

    def pairs(m):
        chunks = [x[i:i + m] for i in range(len(x) - m + 1)]
        return sum(1 for i, a in enumerate(chunks) for j, b in enumerate(chunks)
                   if i != j and max(abs(p - q) for p, q in zip(a, b)) <= tol)
    df = spark.createDataFrame([(x,)], "gap array<bigint>")
    got = df.select(TF.sample_entropy(F.col("gap"))).first()[0]
    assert got == pytest.approx(-math.log(pairs(3) / pairs(2)))


def test_features_without_logs(spark):
    kind = "array<struct<time_ts:bigint,msg_id:bigint,template_id:string,msg_lower:string>>"
    df = spark.createDataFrame([([], 100)], f"t {kind}, fault_ts bigint").withColumn("age", TF.ages("t"))
    stats = df.select(*TF.statistics("t", "t")).first()
    assert all(v == 0 for v in stats)
    assert all(v is None for v in df.select(*TF.age_features("age"), *TF.last_template_frequency("t"),
                                            *TF.keyword_spans("t"), *TF.span_features("age")).first())
    assert tuple(df.select(*TF.last_ids("t")).first()) == ("NULL", "NULL")
    top = df.select(*TF.top_values("t", "msg_id", "msg")).first()
    assert tuple(top) == ("NULL", 0.0) * 3
