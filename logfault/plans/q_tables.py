"""Queries: sources and sinks, union, distinct, nulls and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import templates as T
from ..operators.relational import fill_text, mean_impute
from ..sources import readers, schemas, standin
from ..sources.scratch import scratch_path
from .base import query


@query("a01_csv_scan", """
SELECT sn, epoch_us(time) AS time_us, msg_lower AS msg, server_model FROM plain_logs""")
def csv_scan(spark, folder):
    path = scratch_path(spark, "logs")
    log = standin.logs(spark, folder).select("sn", "time", F.col("msg_lower").alias("msg"), "server_model")
    readers.write_table(log, path, "csv")
    read = readers.read_csv(spark, path, schemas.SYSTEM_LOG)
    return read.select("sn", F.unix_micros("time").alias("time_us"), "msg", "server_model")


@query("a02_csv_string_ids", """
SELECT sn, epoch_us(time) AS fault_us, server_model, lpad(CAST(msg_id AS VARCHAR), 4, '0') AS last_msg_id,
       template_id AS last_template_id, CAST(time_ts % 97 AS DOUBLE) AS cnt_tail20 FROM logs""")
def csv_string_ids(spark, folder):
    path = scratch_path(spark, "features")
    table = standin.logs_with_ids(spark, folder).select(
        "sn", F.col("time").alias("fault_time"), "server_model",
        F.lpad(F.col("msg_id").cast("string"), 4, "0").alias("last_msg_id"),
        F.col("template_id").alias("last_template_id"), (F.col("time_ts") % 97).alias("cnt_tail20"))
    readers.write_table(table, path, "csv")
    read = readers.read_csv(spark, path, schemas.feature_schema(table.columns))
    return read.select("sn", F.unix_micros("fault_time").alias("fault_us"), "server_model",
                       "last_msg_id", "last_template_id", "cnt_tail20")


_SOURCE_TYPES = {"preliminary_sel_log_dataset": "click", "preliminary_sel_log_dataset_a": "view",
                 "preliminary_sel_log_dataset_b": "signup", "final_sel_log_dataset_a": "purchase",
                 "final_sel_log_dataset_b": "error"}


@query("a03_stage_sources", """
SELECT 'other' AS stage, event_type, count(*) AS n, sum(event_id) AS ids FROM ev
WHERE event_type IN ('click', 'view', 'signup') GROUP BY event_type
UNION ALL
SELECT 'final_a', event_type, count(*), sum(event_id) FROM ev
WHERE event_type IN ('click', 'view', 'signup', 'purchase') GROUP BY event_type
UNION ALL
SELECT 'final_b', event_type, count(*), sum(event_id) FROM ev
WHERE event_type IN ('click', 'view', 'signup', 'error') GROUP BY event_type""")
def stage_sources(spark, folder):
    ev = standin.events(spark, folder)
    tables = {name: ev.filter(F.col("event_type") == kind) for name, kind in _SOURCE_TYPES.items()}
    parts = [readers.select_sources(tables, stage, "logs").withColumn("stage", F.lit(stage))
             for stage in ("other", "final_a", "final_b")]
    return (readers.union_all(parts).groupBy("stage", "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")))


@query("a04_sink", """
SELECT fault_id, sn, epoch_us(fault_time) AS fault_us, label FROM faults""")
def sink(spark, folder):
    csv, parquet = scratch_path(spark, "csv"), scratch_path(spark, "parquet")
    faults = standin.faults(spark, folder).select("fault_id", "sn", "fault_time", "label")
    readers.write_table(faults, parquet)
    stored = readers.read_table(spark, parquet)
    readers.write_table(stored, csv, "csv")
    return (readers.read_table(spark, csv, stored.schema, "csv")
            .select("fault_id", "sn", F.unix_micros("fault_time").alias("fault_us"), "label"))


@query("a05_template_snapshot", """
SELECT event_type || ' | k <:NUM:> | <:*:>' AS template, 6 AS n_tokens, event_type AS first_token,
       count(*) AS size FROM ev GROUP BY event_type""")
def template_snapshot(spark, folder):
    log = standin.logs(spark, folder)
    noisy = F.col("msg_lower").startswith("error") | F.col("msg_lower").startswith("view")
    path, again = scratch_path(spark, "templates"), scratch_path(spark, "templates")
    T.save_templates(T.mine_templates(log.filter(noisy)), path)
    T.save_templates(T.mine_templates(log.filter(~noisy), known=T.load_templates(spark, path)), again)
    return (T.load_templates(spark, again)
            .select("template", "n_tokens", "first_token", "size"))


IMPORTANCE_SQL = """
, imp AS (
  SELECT CAST(event_id % 10 AS INTEGER) AS fold, event_type || '_' || k AS feature,
         round(sum(value), 2) AS importance FROM ev GROUP BY 1, 2)
"""


def fold_importance(spark, folder):
    """A per-fold importance table in long form."""
    return (standin.events(spark, folder)
            .groupBy((F.col("event_id") % 10).cast("int").alias("fold"),
                     F.concat_ws("_", "event_type", F.col("k").cast("string")).alias("feature"))
            .agg(F.round(F.sum("value"), 2).alias("importance")))


@query("a06_fold_files", IMPORTANCE_SQL + """
SELECT fold, feature, round(importance, 6) AS importance FROM imp""")
def fold_files(spark, folder):
    path = scratch_path(spark, "importance")
    table = fold_importance(spark, folder).select(
        "importance", "feature", F.concat(F.col("fold").cast("string"), F.lit("_imp2")).alias("file"))
    readers.write_table(table, path, "csv", ["file"])
    return (readers.read_fold_files(spark, f"{path}/*")
            .select("fold", "feature", F.round("importance", 6).alias("importance")))


@query("b01_union_all", """
SELECT label, count(*) AS n FROM (SELECT sn, fault_ts, label FROM faults
  UNION ALL SELECT sn, fault_ts, CAST(-1 AS INTEGER) FROM submit) GROUP BY label""")
def union_all(spark, folder):
    stacked = readers.union_all([
        standin.faults(spark, folder).select("sn", "fault_ts", "label"),
        standin.submit(spark, folder).select("sn", "fault_ts", F.lit(-1).alias("label"))])
    return stacked.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("b02_distinct_rows", """
SELECT DISTINCT sn, label, fault_ts // 86400 AS day FROM
  (SELECT * FROM faults UNION ALL SELECT * FROM faults)""")
def distinct_rows(spark, folder):
    faults = standin.faults(spark, folder).select(
        "sn", "label", F.floor(F.col("fault_ts") / 86400).alias("day"))
    return readers.union_all([faults, faults]).dropDuplicates()


@query("b03_distinct_projection", "SELECT DISTINCT sn, server_model FROM plain_logs")
def distinct_projection(spark, folder):
    return standin.logs(spark, folder).select("sn", "server_model").distinct()


def _with_gaps(spark, folder):
    """Log whose model is unknown for one group of servers and whose message
    is missing where the value is high."""
    return (standin.logs(spark, folder)
            .withColumn("server_model", F.nullif("server_model", F.lit("sm11")))
            .withColumn("msg", F.when(~F.col("msg_lower").endswith("high"), F.col("msg_lower"))))


@query("b04_drop_null_key", "SELECT row_id, server_model FROM plain_logs WHERE server_model <> 'sm11'")
def drop_null_key(spark, folder):
    return _with_gaps(spark, folder).dropna(subset=["server_model"]).select("row_id", "server_model")


@query("b05_fill_constant", """
SELECT row_id, CASE WHEN server_model = 'sm11' THEN 'MISSING' ELSE server_model END AS server_model,
       CASE WHEN msg_lower LIKE '%high' THEN 'MISSING' ELSE msg_lower END AS msg FROM plain_logs""")
def fill_constant(spark, folder):
    return fill_text(_with_gaps(spark, folder)).select("row_id", "server_model", "msg")


@query("b06_mean_imputation", """
, train AS (SELECT fault_id, CASE WHEN label <> 3 THEN CAST(fault_ts % 1000 AS DOUBLE) END AS x FROM faults),
test AS (SELECT fault_id, CASE WHEN fault_id % 3 <> 0 THEN CAST(fault_ts % 1000 AS DOUBLE) END AS x FROM submit)
SELECT 'train' AS part, fault_id, round(coalesce(x, (SELECT avg(x) FROM train)), 6) AS x FROM train
UNION ALL SELECT 'test', fault_id, round(coalesce(x, (SELECT avg(x) FROM test)), 6) FROM test""")
def mean_imputation(spark, folder):
    value = (F.col("fault_ts") % 1000).cast("double")
    train = standin.faults(spark, folder).select("fault_id", F.when(F.col("label") != 3, value).alias("x"))
    test = standin.submit(spark, folder).select("fault_id", F.when(F.col("fault_id") % 3 != 0, value).alias("x"))
    train, test = mean_impute(train, test, ["x"])
    return readers.union_all([train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test"))]) \
        .select("part", "fault_id", F.round("x", 6).alias("x"))


@query("b07_cast", """
SELECT row_id, CAST(msg_id AS VARCHAR) AS msg_text, CAST(template_id AS BIGINT) AS template_number FROM logs""")
def cast(spark, folder):
    return standin.logs_with_ids(spark, folder).select(
        "row_id", F.col("msg_id").cast("string").alias("msg_text"),
        F.col("template_id").cast("bigint").alias("template_number"))


@query("b08_project_rename", """
SELECT fault_ts AS moment, label, fault_id AS id FROM faults""")
def project_rename(spark, folder):
    faults = standin.faults(spark, folder).drop("sn", "fault_time")
    return (faults.withColumnRenamed("fault_ts", "moment").withColumnRenamed("fault_id", "id")
            .select("moment", "label", "id"))
