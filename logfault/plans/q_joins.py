"""Queries: joins, point-in-time joins included."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tail_features as TF
from ..functions.cleaning import list_length, mask
from ..operators import profiles as P, relational as R, timeline as TL
from ..operators.lookup import lookup
from ..operators.ranking import ids_by_first_appearance
from ..sources import standin
from .base import query
from .q_tables import IMPORTANCE_SQL, fold_importance

DAY = 86_400


def plain_tails(spark, folder, n=20):
    """Stand-in faults with the times and texts of their last ``n`` logs."""
    return TL.tail_arrays(standin.logs(spark, folder), standin.faults(spark, folder), n, ["msg_lower"])


def tails(spark, folder, n=50, faults=None):
    """The same with message and template ids."""
    return TL.tail_arrays(standin.logs_with_ids(spark, folder),
                          standin.faults(spark, folder) if faults is None else faults, n,
                          ["msg_id", "template_id", "msg_lower", "server_model"])


@query("d01_lookup_join", """
, models AS (SELECT DISTINCT sn, CASE WHEN k = 3 THEN 'x' ELSE '' END || 'sm' || (user_id % 12) AS server_model
             FROM ev)
SELECT fault_id, coalesce(server_model, 'MISSING') AS server_model FROM faults LEFT JOIN models USING (sn)""")
def lookup_join(spark, folder):
    models = (standin.events(spark, folder)
              .select("sn", F.concat(F.when(F.col("k") == 3, "x").otherwise(""), F.lit("sm"),
                                     (F.col("user_id") % 12).cast("string")).alias("server_model")))
    return P.attach_model(standin.faults(spark, folder), models).select("fault_id", "server_model")


@query("d02_join_aggregates", """
, m AS (SELECT own_model AS server_model, label, count(*) AS label_model_cnt FROM faults GROUP BY 1, 2),
l AS (SELECT label, count(*) AS label_cnt FROM faults GROUP BY 1)
SELECT server_model, label, label_model_cnt, label_cnt FROM m LEFT JOIN l USING (label)""")
def join_aggregates(spark, folder):
    faults = P.attach_model(standin.faults(spark, folder), standin.logs(spark, folder))
    return P.label_shares(faults).select("server_model", "label", "label_model_cnt", "label_cnt")


@query("d03_asof_tail", """
SELECT fault_id, row_id, back, pos FROM t20""")
def asof_tail(spark, folder):
    rows = TL.tail_rows(standin.logs(spark, folder), standin.faults(spark, folder), 20, [])
    return rows.select("fault_id", "row_id", "back", "pos")


@query("d04_bounded_asof", """
, w AS (SELECT * FROM prior WHERE fault_ts - time_ts <= 14400)
SELECT f.fault_id, count(w.row_id) AS n_window, coalesce(sum(length(w.msg_lower)), 0) AS letters,
       coalesce(string_agg(CAST(w.row_id AS VARCHAR), ',' ORDER BY w.back DESC) FILTER (WHERE w.back <= 5), '')
       AS newest5
FROM faults f LEFT JOIN w USING (fault_id) GROUP BY f.fault_id""")
def bounded_asof(spark, folder):
    """Count and text size of the four hours up to the fault, and its last five rows."""
    logs = standin.logs(spark, folder)
    window = TL.window_totals(logs, standin.faults(spark, folder), {"window": 4 * 3600},
                              {"letters": F.length("msg_lower")})
    tail = TL.tail_arrays(logs, window, 5, [], horizon=4 * 3600)
    return tail.select("fault_id", F.col("window_n").alias("n_window"), F.col("window_letters").alias("letters"),
                       F.array_join(F.transform("tail", lambda row: row["row_id"].cast("string")), ",")
                       .alias("newest5"))


@query("d05_interval_count", """
SELECT f.fault_id, count(c.row_id) AS crashdump_cnt FROM faults f LEFT JOIN crash c
  ON c.sn = f.sn AND c.time_ts <= f.fault_ts AND f.fault_ts - c.time_ts <= 86400 GROUP BY f.fault_id""")
def interval_count(spark, folder):
    return (TL.recent_count(standin.crashdump(spark, folder), standin.faults(spark, folder), DAY, "crashdump_cnt")
            .select("fault_id", "crashdump_cnt"))


@query("d06_interval_latest", """
, v AS (SELECT f.fault_id, v.module, row_number() OVER (PARTITION BY f.fault_id ORDER BY v.time DESC, v.row_id DESC) r
  FROM faults f JOIN venus v ON v.sn = f.sn AND v.time_ts <= f.fault_ts AND f.fault_ts - v.time_ts <= 86400)
SELECT f.fault_id, count(v.module) AS venus_cnt,
       coalesce(max(len(string_split(v.module, ','))) FILTER (WHERE r = 1), 0) AS venus_module_cnt
FROM faults f LEFT JOIN v USING (fault_id) GROUP BY f.fault_id""")
def interval_latest(spark, folder):
    venus = standin.venus(spark, folder)
    counted = TL.recent_count(venus, standin.faults(spark, folder), DAY, "venus_cnt")
    latest = TL.latest_within(venus, counted, DAY, ["module"])
    return latest.select("fault_id", "venus_cnt", F.coalesce(
        list_length(F.col("latest.module")), F.lit(0)).cast("bigint").alias("venus_module_cnt"))


@query("d07_look_ahead", """
SELECT f.fault_id, count(l.row_id) AS post_cnt, coalesce(min(l.time_ts) - any_value(f.fault_ts), 0) AS post_span
FROM faults f LEFT JOIN plain_logs l ON l.sn = f.sn AND l.time_ts >= f.fault_ts
GROUP BY f.fault_id""")
def look_ahead(spark, folder):
    return TL.look_ahead(standin.logs(spark, folder), standin.faults(spark, folder)).select("fault_id", "post_cnt", "post_span")


@query("d08_key_join", """
SELECT f.sn, f.fault_ts, f.label, g.n FROM faults f JOIN
  (SELECT sn, fault_ts, label, count(*) AS n FROM faults GROUP BY ALL) g USING (sn, fault_ts, label)""")
def key_join(spark, folder):
    faults = standin.faults(spark, folder).select("sn", "fault_ts", "label")
    other = faults.groupBy("sn", "fault_ts", "label").agg(F.count(F.lit(1)).alias("n"))
    return faults.join(other, ["sn", "fault_ts", "label"], "inner")


@query("d09_fold_join", IMPORTANCE_SQL + """
SELECT feature, round(sum(importance), 6) AS importance FROM imp GROUP BY feature HAVING count(DISTINCT fold) = 10""")
def fold_join(spark, folder):
    return (R.join_folds(fold_importance(spark, folder), 10)
            .select("feature", F.round("importance", 6).alias("importance")))


@query("d10_keyed_append", """
SELECT f.fault_id, f.label, count(l.row_id) AS post_cnt FROM faults f
LEFT JOIN plain_logs l ON l.sn = f.sn AND l.time_ts >= f.fault_ts GROUP BY f.fault_id, f.label""")
def keyed_append(spark, folder):
    faults = standin.faults(spark, folder)
    extra = TL.look_ahead(standin.logs(spark, folder), faults).select("fault_id", "post_cnt")
    return R.keyed_append(faults.select("fault_id", "label"), extra, ["fault_id"])


@query("d11_dictionary_lookup", """
SELECT row_id, CASE WHEN msg_lower LIKE 'view%' THEN 'None' ELSE template END AS template FROM logs""")
def dictionary_lookup(spark, folder):
    """Template of each row from a dictionary that lacks one event type."""
    log = standin.logs(spark, folder)
    known = (ids_by_first_appearance(log, "msg_lower", "msg_id")
             .filter(~F.col("msg_lower").startswith("view")).withColumn("template", mask("msg_lower")))
    return (lookup(log, known, "msg_lower", ["template"], weight="n_rows")
            .select("row_id", F.coalesce("template", F.lit("None")).alias("template")))
