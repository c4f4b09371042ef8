"""Queries: counts, shares, tail statistics and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C, measures as M, tail_features as TF
from ..functions.clock import day_of_week
from ..operators import documents as D, profiles as P, relational as R, timeline as TL
from ..sources import standin
from .base import query
from .q_joins import plain_tails, tails
from .q_tables import IMPORTANCE_SQL, fold_importance


def rounded(columns, keep=()):
    """Doubles rounded to six places, integers as BIGINT, for exact checks."""
    out = []
    for name, kind in columns:
        if kind == "double" and name not in keep:
            out.append(F.round(name, 6).alias(name))
        elif kind == "int":
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return out


def tidy(df):
    return df.select(*rounded(df.dtypes))


def model_faults(spark, folder):
    return P.attach_model(standin.faults(spark, folder), standin.logs(spark, folder))


@query("e01_group_count", "SELECT label, count(*) AS n FROM faults GROUP BY label")
def group_count(spark, folder):
    return standin.faults(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("e02_group_count_two_keys", "SELECT own_model AS server_model, label, count(*) AS n FROM faults GROUP BY 1, 2")
def group_count_two(spark, folder):
    return model_faults(spark, folder).groupBy("server_model", "label").agg(F.count(F.lit(1)).alias("n"))


@query("e03_having", """
SELECT split_part(msg_lower, ' ', 1) AS category, count(*) AS n FROM plain_logs GROUP BY 1 HAVING count(*) > 500""")
def having(spark, folder):
    return (standin.logs(spark, folder).groupBy(C.first_word("msg_lower").alias("category"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 500))


_SHARES = """
, counts AS (SELECT own_model AS server_model, label, count(*) AS n FROM faults GROUP BY 1, 2),
shares AS (SELECT server_model, label, n / sum(n) OVER (PARTITION BY label) AS share FROM counts)
"""


@query("e04_conditional_share", _SHARES + "SELECT server_model, label, round(share, 6) AS share FROM shares")
def conditional_share(spark, folder):
    return tidy(P.label_shares(model_faults(spark, folder)).select("server_model", "label", "share"))


@query("e05_share_columns", _SHARES + """
, first_model AS (SELECT fault_id, arg_max(server_model, back) AS m FROM t20 GROUP BY fault_id)
SELECT f.fault_id, round(coalesce(max(share) FILTER (WHERE s.label = 0), 0), 6) AS server_model_p0,
  round(coalesce(max(share) FILTER (WHERE s.label = 1), 0), 6) AS server_model_p1,
  round(coalesce(max(share) FILTER (WHERE s.label = 2), 0), 6) AS server_model_p2,
  round(coalesce(max(share) FILTER (WHERE s.label = 3), 0), 6) AS server_model_p3
FROM faults f LEFT JOIN first_model m USING (fault_id) LEFT JOIN shares s ON s.server_model = m.m
GROUP BY f.fault_id""")
def share_columns(spark, folder):
    shares = P.label_shares(model_faults(spark, folder))
    first = F.get(F.col("tail"), F.lit(0))["server_model"]
    df = P.attach_shares(tails(spark, folder, 20), shares, first)
    return tidy(df.select("fault_id", *[f"server_model_p{i}" for i in range(4)]))


@query("e05_share_columns_fold_safe", """
, d AS (SELECT fault_id, label, own_model AS server_model, fault_id % 5 AS fold FROM faults),
folds AS (SELECT DISTINCT fold FROM d), c AS (
  SELECT folds.fold, server_model, label, count(*) FILTER (WHERE d.fold <> folds.fold) AS n
  FROM folds CROSS JOIN d GROUP BY 1, 2, 3),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY fold, label) AS share FROM c)
SELECT fault_id, round(coalesce(max(share) FILTER (WHERE s.label = 0), 0), 6) AS server_model_p0,
  round(coalesce(max(share) FILTER (WHERE s.label = 1), 0), 6) AS server_model_p1,
  round(coalesce(max(share) FILTER (WHERE s.label = 2), 0), 6) AS server_model_p2,
  round(coalesce(max(share) FILTER (WHERE s.label = 3), 0), 6) AS server_model_p3
FROM d LEFT JOIN s USING (fold, server_model) GROUP BY fault_id""")
def share_columns_fold_safe(spark, folder):
    faults = model_faults(spark, folder).withColumn("fold", (F.col("fault_id") % 5).cast("int"))
    df = P.attach_shares(faults, P.label_shares(faults, "fold", 5), "server_model", fold="fold")
    return tidy(df.select("fault_id", *[f"server_model_p{i}" for i in range(4)]))


@query("e06_value_mix", """
SELECT label, date_part('isodow', fault_time) - 1 AS weekday, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM faults GROUP BY 1, 2
UNION ALL SELECT label, NULL, count(*), round(count(*) / sum(count(*)) OVER (), 6) FROM faults GROUP BY 1""")
def value_mix(spark, folder):
    faults = standin.faults(spark, folder).withColumn("weekday", day_of_week("fault_time").cast("bigint"))
    overall = P.value_mix(faults, "label").withColumn("weekday", F.lit(None).cast("bigint"))
    by_label = P.value_mix(faults, "weekday", ["label"])
    names = ["label", "weekday", "n", "share"]
    return by_label.select(*names).unionByName(overall.select(*names)) \
        .select("label", "weekday", "n", F.round("share", 6).alias("share"))


_STATS = """
, a AS (SELECT fault_id, count(*) AS n, count(DISTINCT msg_id) AS m, count(DISTINCT template_id) AS t,
    count(DISTINCT msg_id) FILTER (WHERE NOT starts_with(msg_lower, 'processor')) AS p,
    count(DISTINCT trim(split_part(msg_lower, '|', 1))) AS s0,
    count(DISTINCT trim(split_part(msg_lower, '|', 2))) AS s1,
    count(DISTINCT trim(split_part(msg_lower, '|', 3))) AS s2 FROM t20 GROUP BY fault_id),
b AS (SELECT fault_id, count(*) AS n, count(DISTINCT msg_id) AS m, count(DISTINCT template_id) AS t
      FROM t50 GROUP BY fault_id)
SELECT f.fault_id, coalesce(a.n, 0) AS cnt_tail20, round(coalesce(a.n / b.n, 0), 6) AS percent_tail20,
  coalesce(a.m, 0) AS msg_nunique_tail20, coalesce(a.t, 0) AS template_nunique_tail20,
  round(coalesce(a.m / a.n, 0), 6) AS msg_percent_tail20, round(coalesce(a.t / a.n, 0), 6) AS template_percent_tail20,
  round(coalesce(a.t / a.m, 0), 6) AS template_to_msg_percent_tail20,
  round(coalesce(a.m / b.m, 0), 6) AS msg_to_msg_percent_tail20,
  round(coalesce(a.t / b.t, 0), 6) AS template_to_template_percent_tail20,
  coalesce(a.p, 0) AS processor_nunique_tail20,
  coalesce(a.s0, 0) AS msg_split_0_nunique_tail20, coalesce(a.s1, 0) AS msg_split_1_nunique_tail20,
  coalesce(a.s2, 0) AS msg_split_2_nunique_tail20, round(coalesce(a.s0 / a.n, 0), 6) AS msg_split_0_percent_tail20,
  round(coalesce(a.s1 / a.n, 0), 6) AS msg_split_1_percent_tail20,
  round(coalesce(a.s2 / a.n, 0), 6) AS msg_split_2_percent_tail20
FROM faults f LEFT JOIN a USING (fault_id) LEFT JOIN b USING (fault_id)"""


@query("e07_tail_statistics", _STATS)
def tail_statistics(spark, folder):
    df = tails(spark, folder).withColumn("t20", TL.last_n("tail", 20))
    return tidy(df.select("fault_id", *TF.statistics("t20", "tail")))


def _top_sql(value, prefix, order):
    ranks = ", ".join(
        f"coalesce(max(CAST({value} AS VARCHAR)) FILTER (WHERE r = {i}), 'NULL') AS {prefix}_appearance_{i}, "
        f"round(coalesce(max(c / n) FILTER (WHERE r = {i}), 0), 6) AS {prefix}_appearance_{i}_percent"
        for i in (1, 2, 3))
    return f"""
  SELECT f.fault_id, {ranks} FROM faults f LEFT JOIN (
    SELECT fault_id, {value}, count(*) AS c, sum(count(*)) OVER (PARTITION BY fault_id) AS n,
           row_number() OVER (PARTITION BY fault_id ORDER BY count(*) DESC, {order} DESC) AS r
    FROM t20 GROUP BY fault_id, {value}, tpl) x USING (fault_id) GROUP BY f.fault_id"""


@query("e08_top_values", f"""
, tops AS ({_top_sql('template_id', 'tmp', 'tpl')}), msgs AS ({_top_sql('msg_id', 'msg', 'msg_id')})
SELECT * FROM tops JOIN msgs USING (fault_id)""")
def top_values(spark, folder):
    df = tails(spark, folder, 20)
    return tidy(df.select("fault_id", *TF.top_values("tail", "template_id", "tmp", numeric=False),
                          *TF.top_values("tail", "msg_id", "msg")))


@query("e09_last_template", """
, last AS (SELECT fault_id, template_id AS lt FROM t20 WHERE back = 1)
SELECT f.fault_id, x.n AS last_template_cnt, round(x.n / x.total, 6) AS last_template_percent
FROM faults f LEFT JOIN (SELECT fault_id, count(*) FILTER (WHERE template_id = lt) AS n, count(*) AS total
  FROM t20 JOIN last USING (fault_id) GROUP BY fault_id) x USING (fault_id)""")
def last_template(spark, folder):
    return tidy(tails(spark, folder, 20).select("fault_id", *TF.last_template_frequency("tail")))


@query("e10_gap_moments", """
SELECT f.fault_id, round(avg(gap), 6) AS time_diffs_avg_tail20, max(gap) AS time_diffs_max_tail20,
       min(gap) AS time_diffs_min_tail20, round(stddev_pop(gap), 6) AS time_diffs_std_tail20
FROM faults f LEFT JOIN gaps USING (fault_id) GROUP BY f.fault_id""")
def gap_moments(spark, folder):
    df = plain_tails(spark, folder, 20).withColumn("gap", TF.gaps("tail"))
    return tidy(df.select("fault_id", *TF.gap_features("gap")))


def _shape_sql(table, value, prefix):
    return f"""SELECT fault_id, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS {prefix}_skew_tail20,
      CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS {prefix}_kurtosis_tail20 FROM (
      SELECT fault_id, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM (
        SELECT fault_id, {value} AS x, avg({value}) OVER (PARTITION BY fault_id) AS m FROM {table}) GROUP BY fault_id)"""


@query("e11_skew_kurtosis", f"""
, a AS ({_shape_sql('t20', 'CAST(fault_ts - time_ts AS DOUBLE)', 'second_span')}),
b AS ({_shape_sql('gaps', 'CAST(gap AS DOUBLE)', 'time_diffs')})
SELECT f.fault_id, round(second_span_skew_tail20, 6) AS second_span_skew_tail20,
  round(second_span_kurtosis_tail20, 6) AS second_span_kurtosis_tail20,
  round(time_diffs_skew_tail20, 6) AS time_diffs_skew_tail20,
  round(time_diffs_kurtosis_tail20, 6) AS time_diffs_kurtosis_tail20
FROM faults f LEFT JOIN a USING (fault_id) LEFT JOIN b USING (fault_id)""")
def skew_kurtosis(spark, folder):
    df = plain_tails(spark, folder, 20).withColumn("gap", TF.gaps("tail")).withColumn("age", TF.ages("tail"))
    return tidy(df.select("fault_id", *TF.age_spread("age")[1:], *TF.gap_shape("gap")))


_KEYWORDS = ("error", "view", "click", "purchase", "unknown")


@query("e12_keyword_spans", ", ".join(["SELECT f.fault_id"] + [
    f"min(fault_ts_ - time_ts) FILTER (WHERE starts_with(msg_lower, '{w}')) AS {w}_span_time, "
    f"round(avg(fault_ts_ - time_ts) FILTER (WHERE starts_with(msg_lower, '{w}')), 6) AS {w}_mean_span_time"
    for w in _KEYWORDS]) + """
FROM (SELECT fault_id, fault_ts AS fault_ts_ FROM faults) f LEFT JOIN t20 USING (fault_id) GROUP BY f.fault_id""")
def keyword_spans(spark, folder):
    return tidy(plain_tails(spark, folder, 20).select("fault_id", *TF.keyword_spans("tail", keywords=_KEYWORDS)))


@query("e13_recency_counts", ", ".join(["SELECT f.fault_id"] + [
    f"count(p.row_id) FILTER (WHERE p.fault_ts - p.time_ts <= {t}) AS log_cnt_{t}, "
    f"round(CASE WHEN count(p.row_id) > 0 THEN count(p.row_id) FILTER (WHERE p.fault_ts - p.time_ts <= {t}) "
    f"/ count(p.row_id) END, 6) AS log_precent_{t}" for t in (300, 600, 1800, 3600)]) + """
FROM faults f LEFT JOIN prior p USING (fault_id) GROUP BY f.fault_id""")
def recency_counts(spark, folder):
    spans = (300, 600, 1800, 3600)
    df = TL.window_totals(standin.logs(spark, folder), standin.faults(spark, folder), {f"w{t}": t for t in spans})
    columns = ["fault_id"]
    for t in spans:
        columns += [F.coalesce(f"w{t}_n", F.lit(0)).alias(f"log_cnt_{t}"),
                    F.round(M.ratio_or_null(f"w{t}_n", "pos"), 6).alias(f"log_precent_{t}")]
    return df.select(*columns)


def _documents_sql(limit, seconds):
    return f"""
, d AS (SELECT sn, CAST(ceil(epoch_us(time) / {seconds * 1000000}.0) * {seconds} AS BIGINT) AS bucket, msg_lower, time, row_id
  FROM plain_logs),
r AS (SELECT *, row_number() OVER (PARTITION BY sn, bucket ORDER BY time DESC, row_id DESC) AS back FROM d)
SELECT sn, bucket, string_agg(msg_lower, chr(10) ORDER BY time, row_id) AS text FROM r WHERE back <= {limit}
GROUP BY sn, bucket"""


@query("e14_group_text", _documents_sql(20, 1800))
def group_text(spark, folder):
    return D.bucket_documents(standin.logs(spark, folder), 1800, 20)


@query("e14_group_text_tail5", _documents_sql(5, 7200))
def group_text_tail5(spark, folder):
    return D.bucket_documents(standin.logs(spark, folder), 7200, 5)


_PROFILE_SQL = """
, own AS (SELECT DISTINCT fault_id, label, msg_id FROM t20),
top AS (SELECT * FROM (SELECT label, msg_id, count(*) AS n,
   row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, msg_id) AS rank FROM own GROUP BY label, msg_id)
  WHERE rank <= 50)
"""
_MODEL_PROFILE_SQL = """
, own AS (SELECT p.fault_id, f.own_model AS server_model, p.label, p.msg_id FROM prior p JOIN faults f USING (fault_id)
          WHERE back <= 10),
top AS (SELECT * FROM (SELECT server_model, label, msg_id, count(*) AS n,
   row_number() OVER (PARTITION BY server_model, label ORDER BY count(*) DESC, msg_id) AS rank
   FROM own GROUP BY 1, 2, 3) WHERE rank <= 5)
"""


@query("e15_top_per_label", _PROFILE_SQL + "SELECT label, msg_id, n, rank FROM top")
def top_per_label(spark, folder):
    return P.top_messages(tails(spark, folder, 20), ["label"], 20, 50, True)


@query("e16_top_per_model_label", _MODEL_PROFILE_SQL + "SELECT server_model, label, msg_id, n, rank FROM top")
def top_per_model_label(spark, folder):
    df = tails(spark, folder, 10, model_faults(spark, folder))
    return P.top_messages(df, ["server_model", "label"], 10, 5, False)


@query("e17_profile_overlap", _PROFILE_SQL + """
, size AS (SELECT label, count(*) AS n FROM top GROUP BY label),
hit AS (SELECT o.fault_id, t.label, count(*) AS n FROM own o JOIN top t USING (msg_id) GROUP BY 1, 2)
SELECT f.fault_id, round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 0), 0), 6) AS overlap_0,
  round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 1), 0), 6) AS overlap_1,
  round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 2), 0), 6) AS overlap_2,
  round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 3), 0), 6) AS overlap_3
FROM faults f LEFT JOIN hit h USING (fault_id) LEFT JOIN size s ON s.label = h.label GROUP BY f.fault_id""")
def profile_overlap(spark, folder):
    df = tails(spark, folder, 20)
    top = P.top_messages(df, ["label"], 20, 50, True)
    return tidy(P.profile_overlap(df, top, [], 20, ["fault_id"]))


@query("e17_profile_overlap_by_model", _MODEL_PROFILE_SQL + """
, mine AS (SELECT DISTINCT fault_id, server_model, msg_id FROM own),
size AS (SELECT server_model, label, count(*) AS n FROM top GROUP BY 1, 2),
hit AS (SELECT o.fault_id, o.server_model, t.label, count(*) AS n FROM mine o JOIN top t USING (server_model, msg_id)
        GROUP BY 1, 2, 3)
SELECT f.fault_id, round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 0), 0), 6) AS overlap_0,
  round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 1), 0), 6) AS overlap_1,
  round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 2), 0), 6) AS overlap_2,
  round(coalesce(max(h.n / s.n) FILTER (WHERE h.label = 3), 0), 6) AS overlap_3
FROM faults f LEFT JOIN hit h USING (fault_id)
LEFT JOIN size s ON s.label = h.label AND s.server_model = h.server_model GROUP BY f.fault_id""")
def profile_overlap_by_model(spark, folder):
    df = tails(spark, folder, 10, model_faults(spark, folder))
    top = P.top_messages(df, ["server_model", "label"], 10, 5, False)
    return tidy(P.profile_overlap(df, top, ["server_model"], 10, ["fault_id"]))


@query("e18_importance_rank", IMPORTANCE_SQL + """
, total AS (SELECT feature, sum(importance) AS importance FROM imp GROUP BY feature),
r AS (SELECT *, row_number() OVER (ORDER BY importance, feature) AS rank FROM total)
SELECT feature, round(importance, 6) AS importance FROM r WHERE rank > 20""")
def importance_rank(spark, folder):
    totals = (fold_importance(spark, folder).groupBy("feature")
              .agg(F.round(F.sum("importance"), 6).alias("importance")))
    return R.drop_lowest(totals, 20).orderBy("importance", "feature").select("feature", "importance")


@query("e19_exclusion_count", """
, a AS (SELECT f.fault_id, l.msg_lower, row_number() OVER (PARTITION BY f.fault_id ORDER BY l.arrival DESC) AS r
  FROM faults f JOIN (SELECT *, (row_id * 7919) % 1000003 AS arrival FROM plain_logs) l
    ON l.sn = f.sn AND l.time_ts <= f.fault_ts WHERE f.label <= 1)
SELECT f.fault_id, f.label, count(a.msg_lower) FILTER (WHERE r <= 50 AND NOT starts_with(msg_lower, 'view')
  AND NOT starts_with(msg_lower, 'click')) AS n
FROM faults f LEFT JOIN a USING (fault_id) WHERE f.label <= 1 GROUP BY f.fault_id, f.label""")
def exclusion_count(spark, folder):
    """Of the last 50 arrivals before a fault of class 0 or 1, the rows outside
    two message families. The arrival number is shuffled to differ from time."""
    other = ~F.col("msg_lower").startswith("view") & ~F.col("msg_lower").startswith("click")
    logs = (standin.logs(spark, folder)
            .select("sn", "time_ts", ((F.col("row_id") * 7919) % 1000003).alias("row_id"), other.alias("other")))
    faults = standin.faults(spark, folder).filter(F.col("label") <= 1).select("fault_id", "label", "sn", "fault_ts")
    found = (TL.tail_by_arrival(logs, faults, 50, ["other"]).groupBy("fault_id")
             .agg(F.sum(F.col("other").cast("bigint")).alias("n")))
    return (faults.join(found, "fault_id", "left")
            .select("fault_id", "label", F.coalesce("n", F.lit(0)).alias("n")))


@query("e20_coverage", """
, a AS (SELECT 'train' AS dataset, fault_id, sn, fault_ts FROM faults UNION ALL SELECT 'test', * EXCLUDE fault_time FROM submit),
c AS (SELECT a.dataset, a.fault_id, least(count(l.row_id), 10) AS n FROM a LEFT JOIN plain_logs l
      ON l.sn = a.sn AND l.time_ts <= a.fault_ts GROUP BY 1, 2)
SELECT dataset, round(avg(n), 6) AS mean_length FROM c GROUP BY dataset""")
def coverage(spark, folder):
    logs = standin.logs(spark, folder)
    sets = {"train": standin.faults(spark, folder), "test": standin.submit(spark, folder)}
    return tidy(P.coverage({name: TL.window_totals(logs, f, {}) for name, f in sets.items()}, 10))


@query("e21_histogram", """
, x AS (SELECT label, fault_ts % 10000 AS v FROM faults), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
SELECT label, CAST(CASE WHEN v <= lo THEN 0 ELSE least(9, greatest(0, ceil((v - lo) / ((hi - lo) / 10)) - 1)) END AS BIGINT)
  AS bin, count(*) AS n FROM x, b GROUP BY 1, 2""")
def histogram(spark, folder):
    faults = standin.faults(spark, folder).withColumn("v", F.col("fault_ts") % 10000)
    edges = faults.agg(F.min("v").alias("low"), F.max("v").alias("high"))  # one row
    return (faults.crossJoin(F.broadcast(edges))
            .groupBy("label", M.equal_width_bin("v", "low", "high").cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("c14_text_measures", """
, w AS (SELECT fault_id, len(string_split(msg_lower, ' ')) AS n, length(replace(msg_lower, ' ', '')) AS c FROM t20)
SELECT f.fault_id, coalesce(sum(n), 0) AS total_word_cnt, round(avg(n), 6) AS mean_word_cnt_per_sentence,
  round(avg(c), 6) AS mean_alphabet_cnt_per_sentence, round(sum(c) / sum(n), 6) AS mean_alphabet_cnt_per_word
FROM faults f LEFT JOIN w USING (fault_id) GROUP BY f.fault_id""")
def text_measures(spark, folder):
    return tidy(plain_tails(spark, folder, 20).select("fault_id", *TF.text_measures("tail")))
