"""Queries: the assembled feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profiles import attach_model
from ..sources import standin
from . import q_aggregates, q_joins, q_windows  # noqa: F401  (their SQL is read below)
from .base import BASE_SQL, ORACLE, query
from .q_aggregates import tidy
from .stages import build_features

#: Queries whose SQL states one block of the table each, with the columns that bear another name there.
_BLOCKS = ["e05_share_columns", "e07_tail_statistics", "e08_top_values", "e09_last_template", "e10_gap_moments", "e13_recency_counts",
           "f03_last_value", "f04_ages", "f07_span", "f08_longest_run", "d05_interval_count", "g01_abs_energy", "g02_benford",
           "g03_count_above", "g04_count_above_mean", "g05_mean_abs_change", "g06_mean_change", "g09_sample_entropy"]
_PARTS = {"f05_age_spread": "fault_id, second_span_mean_tail20", "d06_interval_latest": "fault_id, venus_module_cnt",
          "e11_skew_kurtosis": "fault_id, time_diffs_skew_tail20, time_diffs_kurtosis_tail20",
          "g07_reoccurring_datapoints": "fault_id, share AS percentage_of_reoccurring_datapoints_to_all_datapoints",
          "g08_reoccurring_values": "fault_id, share AS percentage_of_reoccurring_values_to_all_values"}


def _assembled_sql() -> str:
    """All blocks side by side, for labelled and unlabelled rows."""
    end = "FROM ev WHERE event_type = 'error'),"
    both = BASE_SQL.replace(end, end[:-2] + """
  UNION ALL SELECT event_id, sn, ts, time_ts, NULL, 'sm' || (user_id % 12) FROM ev WHERE event_type = 'purchase'),""", 1)
    parts = {**{name: "*" for name in _BLOCKS}, **_PARTS}
    # The query of runs looks at the first message part; the table at whole messages.
    sql = {**ORACLE, "f08_longest_run": ORACLE["f08_longest_run"].replace("CAST(ascii(msg_lower) AS BIGINT) AS v", "msg_id AS v")}
    tables = [f"(SELECT {columns} FROM ({sql[name].replace(BASE_SQL, both)})) AS {name[:3]}" for name, columns in parts.items()]
    return "SELECT * FROM (" + both + " SELECT fault_id, label FROM faults) AS base JOIN " + " USING (fault_id) JOIN ".join(tables) + " USING (fault_id)"


@query("i16_feature_assembly", _assembled_sql(), base=False)
def feature_assembly(spark, folder):
    """Every column of the feature table but the learned ones, for labelled and unlabelled rows, in one pass."""
    log = standin.logs_with_ids(spark, folder)
    labelled = standin.faults(spark, folder)
    asked = standin.submit(spark, folder).withColumn("label", F.lit(None).cast("int"))
    faults = attach_model(labelled.unionByName(asked), log)
    crash = standin.crashdump(spark, folder).select("sn", F.col("time").alias("fault_time"))
    venus = standin.venus(spark, folder).select("sn", F.col("time").alias("fault_time"), "module")
    made = build_features(log, faults, crash, venus, None, blocks=("shape", "recency", "series"))
    return tidy(made.drop("sn", "fault_time", "server_model"))
