"""Queries: folds, weights, training, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tail_features as TF
from ..functions.measures import two_stage_label
from ..learning import folds as FO, metrics as ME, oversample as OS, two_stage as TS, weights as W
from ..operators import relational as R, timeline as TL
from ..sources import standin
from ..sources.scratch import materialise
from .base import query
from .q_aggregates import model_faults, tidy
from .q_joins import tails
from .q_scalars import _SCORES, scored_faults
from .q_tables import IMPORTANCE_SQL, fold_importance


@query("i01_class_weight", """
, u AS (SELECT CASE WHEN fault_id % 3 = 0 THEN label ELSE 0 END AS label FROM faults)
SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM u GROUP BY label""")
def class_weight(spark, folder):
    return tidy(W.class_weights(uneven(standin.faults(spark, folder))))


def uneven(faults):
    """Classes of uneven size, made from the labels; no row goes."""
    return faults.withColumn("label", F.when(F.col("fault_id") % 3 == 0, F.col("label")).otherwise(0))


@query("i02_stratified_folds", """
SELECT fault_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(fault_id AS VARCHAR) || '42')) - 1) % 10
  AS fold FROM faults""")
def stratified_folds(spark, folder):
    folds = FO.stratified_folds(standin.faults(spark, folder), "label", "fault_id")
    return folds.select("fault_id", "label", F.col("fold").cast("bigint").alias("fold"))


def _group_sql(group):
    return f"""
  SELECT fault_id, CASE WHEN (r // 10) % 2 = 0 THEN r % 10 ELSE 9 - r % 10 END AS fold FROM faults JOIN (
    SELECT {group}, row_number() OVER (ORDER BY count(*) DESC, {group}) - 1 AS r FROM faults GROUP BY {group})
    USING ({group})"""


@query("i03_group_folds", f"""
, a AS ({_group_sql('sn')}), b AS ({_group_sql('own_model')})
SELECT fault_id, a.fold AS by_sn, b.fold AS by_model FROM a JOIN b USING (fault_id)""")
def group_folds(spark, folder):
    faults = model_faults(spark, folder)
    by_sn = FO.group_folds(faults, "sn", out="by_sn")
    both = FO.group_folds(by_sn, "server_model", out="by_model")
    return both.select("fault_id", F.col("by_sn").cast("bigint").alias("by_sn"),
                       F.col("by_model").cast("bigint").alias("by_model"))


NUMERIC = ["cnt_tail20", "msg_nunique_tail20", "template_nunique_tail20", "first_time_span_tail20",
           "second_span0_tail20", "second_span_mean_tail20", "time_diffs_avg_tail20", "time_diffs_max_tail20",
           "tmp_appearance_1_percent", "last_template_percent"]
CATEGORICAL = ["server_model", "last_msg_id", "last_template_id", "tmp_appearance_1"]
SETTINGS = TS.Settings(NUMERIC, CATEGORICAL, trees=10, depth=5, rounds=5, stage_two_depth=4)


def learning_table(spark, folder, test=False):
    """A small feature table of labelled faults or of rows to predict."""
    if test:
        faults = standin.submit(spark, folder).withColumn("label", F.lit(None).cast("int"))
    else:
        faults = standin.faults(spark, folder)
    df = tails(spark, folder, 50, faults)
    df = (df.withColumn("t20", TL.last_n("tail", 20)).withColumn("age", TF.ages("t20"))
          .withColumn("gap", TF.gaps("t20")))
    first = F.get(F.col("t20"), F.lit(0))
    return materialise(df.select(
        "fault_id", "sn", "label", F.coalesce(first["server_model"], F.lit("MISSING")).alias("server_model"),
        *TF.statistics("t20", "tail"), *TF.age_features("age"), *TF.gap_features("gap"), *TF.last_ids("t20"),
        *TF.top_values("t20", "template_id", "tmp", numeric=False), *TF.last_template_frequency("t20")),
        "features")


_FOLDS = """
, folds AS (SELECT fault_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(fault_id AS VARCHAR) || '42'))
            - 1) % 10 AS BIGINT) AS fold FROM faults)
"""


def _held_out(spark, folder, settings=SETTINGS):
    """Every fault scored by the model that has not seen its fold."""
    train = FO.stratified_folds(learning_table(spark, folder), "label", "fault_id", 10)
    return TS.cross_train(train, None, settings, ["fault_id"], 10)[0].withColumn("fold", F.col("fold").cast("bigint"))


@query("i04_stage_one")
def stage_one(spark, folder):
    """Probabilities of CPU, memory and other faults."""
    return _held_out(spark, folder).select("fault_id", "label", "fold", "p1")


@query("i05_stage_two")
def stage_two(spark, folder):
    """The CPU faults, which stage two tells apart."""
    return _held_out(spark, folder).filter(F.col("label") <= 1).select("fault_id", "label", "fold", "p2")


@query("i06_out_of_fold")
def out_of_fold(spark, folder):
    return _held_out(spark, folder).select("fault_id", "label", "fold", "p1", "p2", "guess")


_RUNS = """
, runs AS (SELECT fault_id, r, (fault_id * 7 + r) % 5 / 5 AS a, (fault_id * 3 + r) % 5 / 5 AS b,
           (fault_id * 11 + r) % 5 / 5 AS c, (fault_id * 13 + r) % 7 / 7 AS d, (fault_id * 5 + r) % 7 / 7 AS e
           FROM faults CROSS JOIN range(0, 10) t(r))
"""


def _fold_scores(spark, folder, n=10):
    """Per-fold probabilities of every fault, made from its id."""
    i, r = F.col("fault_id"), F.col("r")
    base = standin.faults(spark, folder).select("fault_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("r"))
    return base.select("fault_id", "r", F.array(*[((i * a + r) % 5) / 5 for a in (7, 3, 11)]).alias("p1"),
                       F.array(*[((i * a + r) % 7) / 7 for a in (13, 5)]).alias("p2"))


def _flat(df):
    return df.select("fault_id", *[F.round(F.get("p1", F.lit(i)), 6).alias(f"p1_{i}") for i in range(3)],
                     *[F.round(F.get("p2", F.lit(i)), 6).alias(f"p2_{i}") for i in range(2)])


@query("i07_fold_average", _RUNS + """
SELECT fault_id, round(avg(a), 6) AS p1_0, round(avg(b), 6) AS p1_1, round(avg(c), 6) AS p1_2,
       round(avg(d), 6) AS p2_0, round(avg(e), 6) AS p2_1 FROM runs GROUP BY fault_id""")
def fold_average(spark, folder):
    return _flat(TS.average_probabilities(_fold_scores(spark, folder), ["fault_id"]))


@query("i08_blend", _RUNS + """
SELECT fault_id, round(sum(a) / 2, 6) AS p1_0, round(sum(b) / 2, 6) AS p1_1, round(sum(c) / 2, 6) AS p1_2,
       round(sum(d) / 2, 6) AS p2_0, round(sum(e) / 2, 6) AS p2_1 FROM runs WHERE r IN (0, 1) GROUP BY fault_id""")
def blend(spark, folder):
    return _flat(TS.average_probabilities(_fold_scores(spark, folder, 2), ["fault_id"]))


@query("i09_two_stage_decision", _SCORES + """
SELECT fault_id, CAST(CASE WHEN p1[1] >= p1[2] AND p1[1] >= p1[3] THEN CASE WHEN p2[1] >= p2[2] THEN 0 ELSE 1 END
  WHEN p1[2] >= p1[3] THEN 2 ELSE 3 END AS BIGINT) AS guess FROM scored""")
def two_stage_decision(spark, folder):
    return scored_faults(spark, folder).select("fault_id", two_stage_label("p1", "p2").cast("bigint").alias("guess"))


_CONFUSION = """
, g AS (SELECT label AS t, CAST((fault_id * 7) % 11 % 4 AS INTEGER) AS p FROM faults),
c AS (SELECT k, count(*) FILTER (WHERE t = k AND p = k) AS tp, count(*) FILTER (WHERE p = k) AS np,
      count(*) FILTER (WHERE t = k) AS nt FROM g CROSS JOIN range(0, 4) r(k) GROUP BY k),
s AS (SELECT k, tp / np AS pr, tp / nt AS re, 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) AS f1, nt FROM c)
"""


def _guesses(spark, folder):
    return standin.faults(spark, folder).withColumn("guess", ((F.col("fault_id") * 7) % 11 % 4).cast("int"))


@query("i10_weighted_f1", _CONFUSION + """
SELECT round(sum(f1 * CASE k WHEN 0 THEN 5 / 11 WHEN 1 THEN 4 / 11 ELSE 1 / 11 END), 6) AS score FROM s""")
def weighted_f1(spark, folder):
    return tidy(ME.weighted_f1(_guesses(spark, folder)))


@query("i11_macro_f1", _CONFUSION + "SELECT round(avg(f1), 6) AS score FROM s")
def macro_f1(spark, folder):
    return tidy(ME.macro_f1(_guesses(spark, folder)))


@query("i12_class_report", _CONFUSION + """
SELECT CAST(k AS VARCHAR) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, nt AS support FROM s
UNION ALL SELECT 'accuracy', round(sum(re * nt) / sum(nt), 6), round(sum(re * nt) / sum(nt), 6),
  round(sum(re * nt) / sum(nt), 6), CAST(sum(nt) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(nt) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(pr * nt) / sum(nt), 6), round(sum(re * nt) / sum(nt), 6),
  round(sum(f1 * nt) / sum(nt), 6), CAST(sum(nt) AS BIGINT) FROM s""")
def class_report(spark, folder):
    return tidy(ME.report(_guesses(spark, folder)))


OVER_NUMERIC = ["cnt_tail20", "second_span_mean_tail20", "time_diffs_avg_tail20"]
OVER_TEXT = ["server_model", "tmp_appearance_1"]


def _oversampled(spark, folder):
    table = uneven(learning_table(spark, folder))
    return materialise(table.select(F.col("fault_id").alias("key"), "label", *OVER_TEXT, *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in OVER_NUMERIC]), "uneven")


@query("i13_oversample")
def oversample(spark, folder):
    """Faults of uneven classes raised to equal size."""
    return OS.oversample(_oversampled(spark, folder), OVER_NUMERIC, OVER_TEXT)


@query("i13_oversample_audit", """
, u AS (SELECT CASE WHEN fault_id % 3 = 0 THEN label ELSE 0 END AS label FROM faults),
n AS (SELECT label, count(*) AS n FROM u GROUP BY label), m AS (SELECT max(n) AS m FROM n)
SELECT label, m AS n, m - n AS n_new, TRUE AS between_rows, TRUE AS known_texts FROM n, m""")
def oversample_audit(spark, folder):
    """Class sizes; new rows lie within the box of their class and take its texts."""
    table = _oversampled(spark, folder)
    numeric, text = OVER_NUMERIC, OVER_TEXT
    made = OS.oversample(table, numeric, text)
    # One row per class: the box of its numbers and the values of its texts.
    box = table.groupBy("label").agg(*[F.min(c).alias(f"lo_{c}") for c in numeric], *[F.max(c).alias(f"hi_{c}") for c in numeric],
                                     *[F.collect_set(F.coalesce(c, F.lit(""))).alias(f"set_{c}") for c in text])
    inside, known = F.lit(True), F.lit(True)
    for c in numeric:
        inside = inside & F.col(c).between(F.col(f"lo_{c}") - 1e-6, F.col(f"hi_{c}") + 1e-6)
    for c in text:
        known = known & F.array_contains(f"set_{c}", F.coalesce(c, F.lit("")))
    return made.join(F.broadcast(box), "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("n_new"), F.every(inside).alias("between_rows"),
        F.every(known).alias("known_texts"))


@query("i14_alternative_booster")
def alternative_booster(spark, folder):
    """Stage two without stage-one probabilities, rows and columns sampled."""
    settings = TS.Settings(NUMERIC, CATEGORICAL, trees=10, depth=5, rounds=5, stage_two_depth=4,
                           use_stage_one=False, row_share=0.8, column_share="0.8")
    return _held_out(spark, folder, settings).filter(F.col("label") <= 1).select("fault_id", "label", "fold", "p2")


@query("i15_importance", IMPORTANCE_SQL + """
, total AS (SELECT feature, sum(importance) AS importance FROM imp GROUP BY feature HAVING count(DISTINCT fold) = 10),
r AS (SELECT *, row_number() OVER (ORDER BY importance, feature) AS rank FROM total)
SELECT feature, round(importance, 6) AS importance FROM r WHERE rank > 20""")
def importance(spark, folder):
    joined = R.join_folds(fold_importance(spark, folder), 10).withColumn("importance", F.round("importance", 6))
    return R.drop_lowest(joined, 20)
