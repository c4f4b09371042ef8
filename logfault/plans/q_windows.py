"""Queries: tails, ranks, sequences and gap series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tail_features as TF
from ..operators import ranking as K, timeline as TL
from ..functions.clock import ceil_to_bucket
from ..sources import standin
from .base import query
from .q_aggregates import tidy
from .q_joins import plain_tails, tails


@query("f01_last_n", """
SELECT f.fault_id, count(*) FILTER (WHERE back <= 5) AS n5, count(*) FILTER (WHERE back <= 10) AS n10,
  count(*) FILTER (WHERE back <= 20) AS n20, count(back) AS n50,
  sum(row_id) FILTER (WHERE back <= 5) AS ids5, sum(row_id) FILTER (WHERE back <= 10) AS ids10,
  sum(row_id) FILTER (WHERE back <= 20) AS ids20, sum(row_id) AS ids50
FROM faults f LEFT JOIN t50 USING (fault_id) GROUP BY f.fault_id""")
def last_n(spark, folder):
    logs = standin.logs(spark, folder)
    df = TL.tail_arrays(logs, standin.faults(spark, folder), 50, [])
    columns = ["fault_id"]
    for n in (5, 10, 20, 50):
        part = TL.last_n("tail", n)
        ids = F.aggregate(TF.field(part, "row_id"), F.lit(0).cast("bigint"), lambda a, x: a + x)
        columns += [F.size(part).cast("bigint").alias(f"n{n}"), F.when(F.size(part) > 0, ids).alias(f"ids{n}")]
    return df.select(*columns)


@query("f02_last_n_per_group", """
SELECT row_id, back FROM (SELECT row_id, row_number() OVER (PARTITION BY sn,
  ceil(epoch_us(time) / 1800000000.0) ORDER BY time DESC, row_id DESC) AS back FROM plain_logs) WHERE back <= 20""")
def last_n_per_group(spark, folder):
    logs = standin.logs(spark, folder).withColumn("bucket", ceil_to_bucket("time", 1800))
    return K.last_per_group(logs, ["sn", "bucket"], [F.col("time").desc(), F.col("row_id").desc()], 20,
                            "back").select("row_id", F.col("back").cast("bigint").alias("back"))


@query("f03_last_value", """
SELECT f.fault_id, coalesce(CAST(max(msg_id) AS VARCHAR), 'NULL') AS last_msg_id,
       coalesce(max(template_id), 'NULL') AS last_template_id
FROM faults f LEFT JOIN (SELECT * FROM t20 WHERE back = 1) USING (fault_id) GROUP BY f.fault_id""")
def last_value(spark, folder):
    return tails(spark, folder, 1).select("fault_id", *TF.last_ids("tail"))


@query("f04_ages", """
SELECT f.fault_id, max(x.fault_ts - time_ts) AS first_time_span_tail20,
  max(x.fault_ts - time_ts) FILTER (WHERE back = 1) AS second_span0_tail20,
  max(x.fault_ts - time_ts) FILTER (WHERE back = 5) AS second_span5_tail20,
  max(x.fault_ts - time_ts) FILTER (WHERE back = 10) AS second_span10_tail20
FROM faults f LEFT JOIN t20 x USING (fault_id) GROUP BY f.fault_id""")
def ages(spark, folder):
    df = plain_tails(spark, folder, 20).withColumn("age", TF.ages("tail"))
    return tidy(df.select("fault_id", *TF.age_features("age")[:4]))


@query("f05_age_spread", """
SELECT f.fault_id, round(avg(x.fault_ts - time_ts), 6) AS second_span_mean_tail20,
  round(stddev_pop(x.fault_ts - time_ts), 6) AS second_span_std_tail20
FROM faults f LEFT JOIN t20 x USING (fault_id) GROUP BY f.fault_id""")
def age_spread(spark, folder):
    df = plain_tails(spark, folder, 20).withColumn("age", TF.ages("tail"))
    return tidy(df.select("fault_id", TF.age_features("age")[4], TF.age_spread("age")[0]))


@query("f06_gaps", "SELECT fault_id, back, gap FROM gaps")
def gaps(spark, folder):
    df = plain_tails(spark, folder, 20).select("fault_id", F.posexplode(TF.gaps("tail")).alias("i", "gap"),
                                         F.size("tail").alias("n"))
    return df.select("fault_id", (F.col("n") - 1 - F.col("i")).cast("bigint").alias("back"), "gap")


@query("f07_span", """
SELECT f.fault_id, max(time_ts) - min(time_ts) AS max_time_diff_tail20,
  round(CASE WHEN max(x.fault_ts - time_ts) > 0 THEN (max(time_ts) - min(time_ts)) / max(x.fault_ts - time_ts) END, 6)
    AS max_time_diff_div_first_time_span_tail20
FROM faults f LEFT JOIN t20 x USING (fault_id) GROUP BY f.fault_id""")
def span(spark, folder):
    df = plain_tails(spark, folder, 20).withColumn("age", TF.ages("tail"))
    return tidy(df.select("fault_id", *TF.span_features("age")))


# Runs are looked for in the first message part: whole messages seldom repeat.
_RUNS = """
, cat AS (SELECT fault_id, back, CAST(ascii(msg_lower) AS BIGINT) AS v FROM t20),
g AS (SELECT *, row_number() OVER (PARTITION BY fault_id ORDER BY back DESC)
             - row_number() OVER (PARTITION BY fault_id, v ORDER BY back DESC) AS island FROM cat),
runs AS (SELECT fault_id, v, count(*) AS n, max(back) AS start FROM g GROUP BY fault_id, v, island),
best AS (SELECT fault_id, max(n) AS n FROM runs GROUP BY fault_id)
"""


def _coded(spark, folder):
    df = plain_tails(spark, folder, 20)
    return df.withColumn("tail", F.transform("tail", lambda row: F.struct(
        F.ascii(row["msg_lower"]).cast("bigint").alias("msg_id"))))


@query("f08_longest_run", _RUNS + """
SELECT f.fault_id, coalesce(CAST(max(c.v) AS VARCHAR), 'NULL') AS max_continuous_msg,
       coalesce(max(CASE WHEN b.n >= 2 THEN b.n ELSE 0 END), 0) AS max_continuous_time
FROM faults f LEFT JOIN best b USING (fault_id) LEFT JOIN (SELECT * FROM cat WHERE back = 1) c USING (fault_id)
GROUP BY f.fault_id""")
def longest_run(spark, folder):
    return tidy(_coded(spark, folder).select("fault_id", *TF.longest_run("tail")))


@query("f08_longest_run_strict", _RUNS + """
SELECT f.fault_id, coalesce(CAST(arg_max(r.v, r.start) AS VARCHAR), 'NULL') AS max_continuous_msg,
       coalesce(max(r.n), 0) AS max_continuous_time
FROM faults f LEFT JOIN best b USING (fault_id) LEFT JOIN runs r ON r.fault_id = b.fault_id AND r.n = b.n
GROUP BY f.fault_id""")
def longest_run_strict(spark, folder):
    return tidy(_coded(spark, folder).select("fault_id", *TF.longest_run("tail", "strict")))


@query("f09_first_appearance_ids", "SELECT row_id, msg_id FROM logs")
def first_appearance_ids(spark, folder):
    return standin.logs_with_ids(spark, folder).select("row_id", "msg_id")


@query("f10_sort", "SELECT fault_id, fault_ts FROM faults ORDER BY fault_ts, fault_id")
def sort(spark, folder):
    return standin.faults(spark, folder).select("fault_id", "fault_ts").orderBy("fault_ts", "fault_id")


@query("f11_filters", """
SELECT f.fault_id, min(x.fault_ts - time_ts) AS span FROM faults f JOIN t20 x USING (fault_id)
WHERE f.sn <> '7' GROUP BY f.fault_id HAVING min(x.fault_ts - time_ts) < 10000
  AND arg_min(msg_lower, back) LIKE 'error%'""")
def filters(spark, folder):
    df = plain_tails(spark, folder, 1).filter(F.col("sn") != "7")
    last = F.get(F.col("tail"), F.lit(0))
    return (df.select("fault_id", (F.col("fault_ts") - last["time_ts"]).alias("span"), last["msg_lower"].alias("m"))
            .filter((F.col("span") < 10000) & F.col("m").startswith("error")).select("fault_id", "span"))


def _series(spark, folder, *columns):
    df = plain_tails(spark, folder, 20).withColumn("gap", TF.gaps("tail"))
    return tidy(df.select("fault_id", *columns))


@query("g01_abs_energy", """
SELECT f.fault_id, CAST(sum(gap * gap) AS BIGINT) AS abs_energy FROM faults f LEFT JOIN gaps USING (fault_id) GROUP BY 1""")
def abs_energy(spark, folder):
    return _series(spark, folder, TF.abs_energy(F.col("gap")).alias("abs_energy"))


@query("g02_benford", """
, digits AS (SELECT d, log10(1 + 1 / d) AS law FROM range(1, 10) t(d)),
g AS (SELECT fault_id, count(*) AS n FROM gaps GROUP BY 1),
c AS (SELECT fault_id, CAST(left(CAST(gap AS VARCHAR), 1) AS BIGINT) AS d, count(*) AS k FROM gaps GROUP BY 1, 2),
s AS (SELECT g.fault_id, d.law, coalesce(c.k, 0) / g.n AS share FROM g CROSS JOIN digits d
      LEFT JOIN c ON c.fault_id = g.fault_id AND c.d = d.d),
r AS (SELECT fault_id, CASE WHEN max(share) > min(share) THEN corr(share, law) END AS r FROM s GROUP BY 1)
SELECT f.fault_id, round(r, 6) AS benford_correlation FROM faults f LEFT JOIN r USING (fault_id)""")
def benford(spark, folder):
    return _series(spark, folder, TF.benford_correlation(F.col("gap")).alias("benford_correlation"))


@query("g03_count_above", """
SELECT f.fault_id, round(avg(CASE WHEN gap >= 3600 THEN 1 WHEN gap < 3600 THEN 0 END), 6) AS count_above
FROM faults f LEFT JOIN gaps USING (fault_id) GROUP BY 1""")
def count_above(spark, folder):
    return _series(spark, folder, TF.count_above(F.col("gap")).alias("count_above"))


@query("g04_count_above_mean", """
SELECT f.fault_id, CAST(sum(CASE WHEN gap > m THEN 1 WHEN gap <= m THEN 0 END) AS BIGINT) AS count_above_mean
FROM faults f LEFT JOIN (SELECT *, avg(gap) OVER (PARTITION BY fault_id) AS m FROM gaps) USING (fault_id) GROUP BY 1""")
def count_above_mean(spark, folder):
    return _series(spark, folder, TF.count_above_mean(F.col("gap")).alias("count_above_mean"))


@query("g05_mean_abs_change", """
SELECT f.fault_id, round(avg(abs(c)), 6) AS mean_abs_change FROM faults f LEFT JOIN (
  SELECT fault_id, gap - lag(gap) OVER (PARTITION BY fault_id ORDER BY back DESC) AS c FROM gaps) USING (fault_id)
GROUP BY 1""")
def mean_abs_change(spark, folder):
    return _series(spark, folder, TF.mean_abs_change(F.col("gap")).alias("mean_abs_change"))


@query("g06_mean_change", """
SELECT f.fault_id, round(CASE WHEN count(gap) > 1 THEN (arg_min(gap, back) - arg_max(gap, back)) / (count(gap) - 1) END, 6)
  AS mean_change FROM faults f LEFT JOIN gaps USING (fault_id) GROUP BY 1""")
def mean_change(spark, folder):
    return _series(spark, folder, TF.mean_change(F.col("gap")).alias("mean_change"))


@query("g07_reoccurring_datapoints", """
SELECT f.fault_id, round(coalesce(sum(c) FILTER (WHERE c > 1), 0) / sum(c), 6) AS share FROM faults f LEFT JOIN
  (SELECT fault_id, gap, count(*) AS c FROM gaps GROUP BY 1, 2) USING (fault_id) GROUP BY 1""")
def reoccurring_datapoints(spark, folder):
    return _series(spark, folder, TF.reoccurring_datapoints(F.col("gap")).alias("share"))


@query("g08_reoccurring_values", """
SELECT f.fault_id, round(CASE WHEN count(c) > 0 THEN count(c) FILTER (WHERE c > 1) / count(c) END, 6) AS share
FROM faults f LEFT JOIN (SELECT fault_id, gap, count(*) AS c FROM gaps GROUP BY 1, 2) USING (fault_id) GROUP BY 1""")
def reoccurring_values(spark, folder):
    return _series(spark, folder, TF.reoccurring_values(F.col("gap")).alias("share"))


@query("g09_sample_entropy", """
, x AS (SELECT fault_id, row_number() OVER (PARTITION BY fault_id ORDER BY back DESC) AS i, gap,
        lead(gap, 1) OVER w AS g1, lead(gap, 2) OVER w AS g2, 0.2 * stddev_pop(gap) OVER (PARTITION BY fault_id) AS tol
        FROM gaps WINDOW w AS (PARTITION BY fault_id ORDER BY back DESC)),
pairs AS (SELECT a.fault_id,
   count(*) FILTER (WHERE abs(a.gap - b.gap) <= a.tol AND abs(a.g1 - b.g1) <= a.tol) AS b2,
   count(*) FILTER (WHERE abs(a.gap - b.gap) <= a.tol AND abs(a.g1 - b.g1) <= a.tol AND abs(a.g2 - b.g2) <= a.tol) AS a3
   FROM x a JOIN x b ON a.fault_id = b.fault_id AND a.i <> b.i GROUP BY 1)
SELECT f.fault_id, round(CASE WHEN a3 > 0 AND b2 > 0 THEN -ln(a3 / b2) END, 6) AS sample_entropy
FROM faults f LEFT JOIN pairs USING (fault_id)""")
def sample_entropy(spark, folder):
    return _series(spark, folder, TF.sample_entropy(F.col("gap")).alias("sample_entropy"))
