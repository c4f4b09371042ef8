"""The three stages: logs to templates, faults to features, features to answers.

Every stage takes and returns DataFrames; the caller reads and writes them
with ``sources.readers``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import tail_features as TF
from ..functions.cleaning import list_length, normalise_messages, words
from ..functions.clock import epoch_seconds
from ..functions.measures import ratio_or_null
from ..functions.vectors import spread_columns
from ..learning import folds, two_stage as TS
from ..operators import documents as D, embeddings as E, factors as X, profiles as P, templates as T, timeline as TL
from ..operators.lookup import lookup
from ..operators.ranking import ids_by_first_appearance
from ..operators.relational import fill_text
from ..sources import readers as R
from ..sources.readers import union_all
from ..sources.schemas import CATEGORICAL_FEATURES, KEY_COLUMNS
from ..sources.scratch import materialise

DAY = 86_400
BUCKET = 1_800
TAIL, LONG_TAIL = 20, 50
VECTOR_SIZE = 64
#: Seconds of the recency counts and of the short feature set.
RECENT, SHORT = (300, 600, 1_800, 3_600), 14_400


def template_logs(logs: DataFrame, known: DataFrame | None = None, **mining):
    """Clean the messages, number them, mine templates and match every row.

    ``logs`` has ``sn, time, msg, server_model, row_id``. Returns the log with
    ``time_ts, msg_lower, msg_id, template_id, template``, and the template
    dictionary to hand to the next run as ``known``.
    """
    clean = fill_text(logs.dropna(subset=["server_model"])).withColumn("time_ts", epoch_seconds("time"))
    clean = normalise_messages(clean)
    ids = materialise(ids_by_first_appearance(clean, "msg_lower", "msg_id"), "messages")
    numbered = lookup(clean, ids, "msg_lower", ["msg_id"], weight="n_rows")
    templates = T.mine_templates(clean, known=known, **mining)
    return T.attach_templates(numbered, templates), templates


def prepare_faults(labels: DataFrame, submit: DataFrame, logs: DataFrame) -> DataFrame:
    """Distinct labelled faults and rows to predict (null label) with their
    model, seconds and a stable ``fault_id``."""
    known = labels.dropDuplicates().select("sn", "fault_time", F.col("label").cast("int").alias("label"))
    asked = submit.select("sn", "fault_time", F.lit(None).cast("int").alias("label"))
    both = P.attach_model(known.unionByName(asked), logs)
    both = both.withColumn("fault_ts", epoch_seconds("fault_time"))
    return materialise(_with_id(both, ["sn", "fault_time", "label", "server_model"], "fault_id"), "faults")


def _with_id(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """An id that is a hash of the row's own columns, so it does not depend on
    partitions; equal rows are numbered."""
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))
    # The label is hashed as text: a null must not hash like nothing at all.
    values = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return df.withColumn(name, F.xxhash64(*values, nth))


@dataclass
class TextModels:
    """Word vectors and SVD loadings fitted on the log."""

    word_vectors: DataFrame
    components: DataFrame


def fit_text(log: DataFrame, min_df: int = 5, max_features: int = 50_000, components: int = X.COMPONENTS,
             size: int = VECTOR_SIZE) -> TextModels:
    docs = materialise(D.bucket_documents(log, BUCKET, TAIL), "documents")
    vectors = materialise(E.fit_word_vectors(docs, words("text"), size), "words")
    counts = D.term_counts(docs, ["sn", "bucket"], "text", 1, 3)
    vocab = materialise(D.vocabulary(counts, docs.count(), min_df, max_features), "vocabulary")
    loadings, _ = X.fit_svd(counts, vocab, ["sn", "bucket"], components)
    return TextModels(vectors, loadings)


def _context(events: DataFrame) -> DataFrame:
    """``fault_time`` tables as event logs."""
    named = events.withColumnRenamed("fault_time", "time")
    return named.withColumn("row_id", F.xxhash64(*named.columns)).withColumn("time_ts", epoch_seconds("time"))


def build_features(log: DataFrame, faults: DataFrame, crashdump: DataFrame, venus: DataFrame, text: TextModels | None,
                   size: int = VECTOR_SIZE, components: int = X.COMPONENTS, fold: str | None = None,
                   n_folds: int = 10, blocks: tuple[str, ...] = (), horizon: int | None = None) -> DataFrame:
    """One row of features per fault, labelled or not.

    The tails are built once and written; every feature block reads them.
    With ``fold`` (a column of ``faults``, null for rows to predict) the label
    shares of a training row leave out its own fold. ``blocks`` names optional
    features: ``shape`` (skew and kurtosis of the gaps), ``keywords`` (spans
    by first word), ``recency`` (logs of the last minutes), ``series`` (the
    gaps as a time series). With ``horizon`` only logs of the so many seconds
    up to a fault count, :data:`SHORT` for the four-hour set. Without
    ``text`` the learned columns are left out.
    """
    unknown = set(blocks) - {"shape", "keywords", "recency", "series"}
    if unknown:
        raise ValueError(f"no such blocks: {sorted(unknown)}")
    tails = TL.tail_arrays(log, faults, LONG_TAIL, ["msg_id", "template_id", "msg_lower", "server_model"], horizon=horizon)
    tails = materialise(tails.withColumn("t20", TL.last_n("tail", TAIL)), "tails")
    id_ = ["fault_id"]

    labelled = faults.filter(F.col("label").isNotNull())
    shares = P.label_shares(labelled)
    first_model = F.get(F.col("t20"), F.lit(0))["server_model"]
    asked = tails.select("fault_id", first_model.alias("_first"))
    if fold is None:
        with_shares = P.attach_shares(asked, shares, "_first")
    else:
        shares = P.label_shares(labelled, fold, n_folds).unionByName(shares.withColumn(fold, F.lit(-1)))
        asked = asked.join(faults.select("fault_id", F.coalesce(fold, F.lit(-1)).alias(fold)), "fault_id")
        with_shares = P.attach_shares(asked, shares, "_first", fold=fold).drop(fold)
    crashes = TL.recent_count(_context(crashdump), faults.select("fault_id", "sn", "fault_ts"), DAY, "crashdump_cnt")
    modules = TL.latest_within(materialise(_context(venus), "venus"),
                               faults.select("fault_id", "sn", "fault_ts"), DAY, ["module"])
    module_count = F.coalesce(list_length(F.col("latest.module")), F.lit(0)).alias("venus_module_cnt")

    own = tails.withColumn("age", TF.ages("t20")).withColumn("gap", TF.gaps("t20")).select(
        "fault_id", "sn", "fault_time", "label", "server_model", *TF.last_ids("tail"),
        *TF.statistics("t20", "tail"), *TF.age_features("age"), *TF.gap_features("gap"), *TF.span_features("age"),
        *TF.top_values("t20", "template_id", "tmp", numeric=False), *TF.top_values("t20", "msg_id", "msg"),
        *TF.longest_run("t20"), *TF.last_template_frequency("t20"), *(TF.gap_shape("gap") if "shape" in blocks else ()),
        *(TF.keyword_spans("t20") if "keywords" in blocks else ()), *(TF.gap_series("gap") if "series" in blocks else ()))
    # Written before the joins, so that their plans are re-optimised without these expressions.
    own = materialise(own, "own")
    if "recency" in blocks:
        spans = {f"w{t}": t for t in RECENT}
        recent = TL.window_totals(log, faults.select("fault_id", "sn", "fault_ts"), spans)
        own = own.join(recent.select("fault_id", *[c for t in RECENT for c in (
            F.coalesce(f"w{t}_n", F.lit(0)).alias(f"log_cnt_{t}"), ratio_or_null(f"w{t}_n", "pos").alias(f"log_precent_{t}"))]), id_)
    if text is not None:
        vectors = E.tail_mean_vectors(tails.select("fault_id", "t20"), id_, text.word_vectors, size, "t20")
        terms = D.term_counts(tails.select("fault_id", E.tail_text("t20").alias("text")), id_, "text", 1, 3)
        topics = X.project(terms, text.components, tails.select("fault_id"), id_, components)
        own = (own.join(vectors.select("fault_id", *spread_columns("vector", "w2v", size)), id_)
               .join(topics.select("fault_id", *spread_columns("tfv", "tfv", components)), id_))
    return (own
            .join(with_shares.drop("_first"), id_)
            .join(crashes.select("fault_id", "crashdump_cnt"), id_)
            .join(modules.select("fault_id", module_count), id_))


def feature_settings(features: DataFrame, **options) -> TS.Settings:
    """All columns but the keys as model inputs."""
    skip = {*KEY_COLUMNS, "fault_id", "fault_ts", "fold", *CATEGORICAL_FEATURES}
    return TS.Settings([c for c in features.columns if c not in skip], list(CATEGORICAL_FEATURES), **options)


def train_and_predict(features: DataFrame, n_folds: int = 10, fold_kinds=("stratified",), **options):
    """Cross-validated training and the answers for the unlabelled rows.

    ``fold_kinds``: any of ``stratified``, ``sn``, ``server_model``; the
    probabilities of several runs are averaged. Returns ``(answers,
    out_of_fold, importance)``, the last two with the ``run`` they are of.
    """
    settings = feature_settings(features, **options)
    train = materialise(features.filter(F.col("label").isNotNull()), "train")
    test = materialise(features.filter(F.col("label").isNull()), "test")
    runs, helds, importances = [], [], []
    for kind in fold_kinds:
        folded = (folds.stratified_folds(train, "label", "fault_id", n_folds) if kind == "stratified"
                  else folds.group_folds(train, kind, n_folds))
        held, mean, importance = TS.cross_train(folded, test, settings, ["fault_id"], n_folds)
        runs.append(mean)
        helds.append(held.withColumn("run", F.lit(kind)))
        importances.append(importance.withColumn("run", F.lit(kind)))
    blended = TS.decide(TS.average_probabilities(union_all(runs), ["fault_id"]), "answer")
    answers = test.select("fault_id", "sn", "fault_time").join(blended.select("fault_id", "answer"), "fault_id")
    return answers.select("sn", "fault_time", F.col("answer").alias("label")), union_all(helds), union_all(importances)


def run(spark: SparkSession, folder: str, out: str, stage: str | None = None, final_folder: str | None = None,
        known: DataFrame | None = None, blocks: tuple[str, ...] = (), horizon: int | None = None, **options) -> DataFrame:
    """From a folder of CSV files to a folder of results: all three stages.

    Reads the files that belong to ``stage`` (those of the final rounds from
    ``final_folder``) and writes below ``out``: ``templates``, ``log``,
    ``features``, ``out_of_fold``, ``importance`` and, as CSV, ``answers``.
    Returns the answers.
    """
    read = {kind: R.read_stage(spark, folder, stage, kind, final_folder) for kind in ("logs", "labels", "submit", "crashdump", "venus")}

    def kept(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
        R.write_table(df, f"{out}/{name}", fmt)
        return spark.read.schema(df.schema).parquet(f"{out}/{name}") if fmt == "parquet" else df

    log, templates = template_logs(read["logs"], known)
    kept(templates, "templates")
    log = kept(log, "log")
    faults = prepare_faults(read["labels"], read["submit"], log)
    sizes = {k: options.pop(k) for k in ("size", "components") if k in options}
    features = kept(build_features(log, faults, read["crashdump"], read["venus"], fit_text(log, **sizes), blocks=blocks,
                                   horizon=horizon, **sizes), "features")
    answers, held, importance = train_and_predict(features, **options)
    kept(held, "out_of_fold")
    kept(importance, "importance")
    return kept(answers, "answers", "csv")
