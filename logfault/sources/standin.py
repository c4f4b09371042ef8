"""The pipeline's input tables, taken from the benchmark tables.

``events`` plays the system log; its event types play faults (``error``),
rows to predict (``purchase``), crash dumps (``signup``) and hardware module
reports (``view``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cleaning import mask
from ..functions.clock import epoch_seconds
from ..operators.lookup import lookup
from ..operators.ranking import ids_by_first_appearance


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark, folder) -> DataFrame:
    """``events`` with ``sn``, UTC time, epoch seconds and the number in ``props``."""
    raw = table(spark, folder, "events")
    return raw.select(
        F.col("event_id"), F.col("user_id"), F.col("user_id").cast("string").alias("sn"),
        F.col("ts").cast("timestamp").alias("time"), "event_type", "value",
        (F.translate("props", '{"k": }', "").cast("int") % 10).alias("k"),
    ).withColumn("time_ts", epoch_seconds("time"))


def logs(spark, folder) -> DataFrame:
    level = F.when(F.col("value") < 20, "low").when(F.col("value") < 100, "mid").otherwise("high")
    return events(spark, folder).select(
        "sn", "time", "time_ts", F.col("event_id").alias("row_id"),
        F.concat(F.lit("sm"), (F.col("user_id") % 12).cast("string")).alias("server_model"),
        F.concat_ws(" | ", "event_type", F.concat(F.lit("k "), F.col("k").cast("string")), level).alias("msg_lower"))


def logs_with_ids(spark, folder) -> DataFrame:
    """Log with message ids and, in the role of templates, ids of the masked text."""
    log = logs(spark, folder)
    ids = ids_by_first_appearance(log, "msg_lower", "msg_id").withColumn("template", mask("msg_lower"))
    templates = ids_by_first_appearance(
        ids.select("template", F.col("first_row").alias("row_id")), "template", "template_id", first=1)
    numbered = (ids.join(templates.select("template", "template_id"), "template")
                .withColumn("template_id", F.col("template_id").cast("string")))
    return lookup(log, numbered, "msg_lower", ["msg_id", "template_id", "template"])


def _faults(spark, folder, kind) -> DataFrame:
    return (events(spark, folder).filter(F.col("event_type") == kind)
            .select(F.col("event_id").alias("fault_id"), "sn", F.col("time").alias("fault_time"),
                    F.col("time_ts").alias("fault_ts"), "user_id"))


def faults(spark, folder) -> DataFrame:
    return (_faults(spark, folder, "error")
            .select("fault_id", "sn", "fault_time", "fault_ts",
                    (F.col("fault_id") % 4).cast("int").alias("label")))


def submit(spark, folder) -> DataFrame:
    return _faults(spark, folder, "purchase").drop("user_id")


def crashdump(spark, folder) -> DataFrame:
    return (_faults(spark, folder, "signup")
            .select("sn", F.col("fault_time").alias("time"), F.col("fault_ts").alias("time_ts"),
                    F.col("fault_id").alias("row_id")))


def venus(spark, folder) -> DataFrame:
    module = F.array_join(F.array_repeat(F.lit("m"), (F.col("fault_id") % 3 + 1).cast("int")), ",")
    return (_faults(spark, folder, "view")
            .select("sn", F.col("fault_time").alias("time"), F.col("fault_ts").alias("time_ts"),
                    F.col("fault_id").alias("row_id"), module.alias("module")))


def word_vectors(spark, folder, words: DataFrame) -> DataFrame:
    """``word, vector`` for the given distinct words.

    A word's vector is the row of ``embeddings`` named by its hash; some
    hashes point past the table, so some words are out of vocabulary.
    """
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    slot = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % VECTOR_SLOTS
    return words.withColumn("vec_id", slot).join(vectors, "vec_id").select("word", "vector")


VECTOR_SLOTS = 600
