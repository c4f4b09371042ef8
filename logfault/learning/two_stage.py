"""Two-stage fault classification.

Stage one tells CPU faults (labels 0 and 1 together) from memory and other
faults; stage two splits the CPU faults, with the stage-one probabilities as
extra features. Fits run distributed; only the loop over folds is on the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.measures import stage_one_label, two_stage_label
from ..sources.readers import union_all
from ..sources.scratch import materialise
from .weights import attach_weights

#: Split points that the trees try per column.
MAX_BINS = 128
STAGE_ONE_CLASSES = 3


@dataclass
class Settings:
    """Which columns to use and how large the models are."""

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    first: str = "forest"
    trees: int = 50
    depth: int = 8
    rounds: int = 50
    rate: float = 0.1
    stage_two_depth: int = 5
    use_stage_one: bool = True
    row_share: float = 1.0
    column_share: str = "auto"
    seed: int = 42


class Encoder:
    """Numbers for the learner: category ranks by frequency, null numbers as -1.

    A category is its frequency rank, an ordered number that trees can split,
    whatever the number of values; a value that training has not seen comes
    last. The distinct values of the columns reach the driver.
    """

    def __init__(self, train: DataFrame, settings: Settings):
        self.settings = settings
        columns = settings.categorical
        self.model = None
        if columns:
            indexers = StringIndexer(inputCols=columns, outputCols=[f"_i_{c}" for c in columns],
                                     handleInvalid="keep", stringOrderType="frequencyDesc")
            self.model = indexers.fit(train.select(*[F.coalesce(c, F.lit("MISSING")).alias(c) for c in columns]))

    def transform(self, df: DataFrame, extra=(), out: str = "features") -> DataFrame:
        s = self.settings
        df = df.fillna("MISSING", s.categorical) if s.categorical else df
        if self.model is not None:
            df = self.model.transform(df)
        # Without the list of values in its metadata a column is a plain number.
        df = df.withColumns({f"_i_{c}": F.col(f"_i_{c}").alias(f"_i_{c}", metadata={}) for c in s.categorical})
        numbers = [*s.numeric, *extra]
        df = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_x_{c}") for c in numbers])
        inputs = [f"_x_{c}" for c in numbers] + [f"_i_{c}" for c in s.categorical]
        assembled = VectorAssembler(inputCols=inputs, outputCol=out).transform(df)
        return assembled.drop(*inputs)

    def feature_names(self, extra=()) -> list[str]:
        return [*self.settings.numeric, *extra, *self.settings.categorical]


def first_learner(settings: Settings, max_bins: int = MAX_BINS):
    if settings.first == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", family="multinomial",
                                  probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_guess")
    return RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", probabilityCol="_p",
                                  rawPredictionCol="_raw", predictionCol="_guess", numTrees=settings.trees,
                                  maxDepth=settings.depth, maxBins=max_bins, seed=settings.seed,
                                  subsamplingRate=settings.row_share,
                                  featureSubsetStrategy=settings.column_share)


def second_learner(settings: Settings, max_bins: int = MAX_BINS):
    return GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=settings.rounds,
                         stepSize=settings.rate, maxDepth=settings.stage_two_depth, maxBins=max_bins,
                         seed=settings.seed, validationIndicatorCol="_valid", validationTol=0.001,
                         subsamplingRate=settings.row_share,
                         featureSubsetStrategy="all" if settings.column_share == "auto" else settings.column_share)


class TwoStageModel:
    """Both stages fitted on the rows that are not held out.

    ``train`` has ``label``, the feature columns and the boolean ``held_out``;
    held-out rows only decide when boosting stops.
    """

    def __init__(self, train: DataFrame, settings: Settings):
        self.settings = settings
        seen = train.filter(~F.col("held_out"))
        self.encoder = Encoder(seen, settings)
        encoded = self.encoder.transform(seen).withColumn("y", stage_one_label("label").cast("double"))
        self.one = first_learner(settings).fit(attach_weights(encoded, "y"))
        cpu = self._with_first(train.filter(F.col("label") <= 1)).withColumn("y", F.col("label").cast("double"))
        # Class weights come from the training rows alone.
        counted = seen.filter(F.col("label") <= 1).withColumn("y", F.col("label").cast("double"))
        cpu = attach_weights(self.encoder.transform(cpu, self._extra), "y", counted=counted)
        self.two = second_learner(settings).fit(cpu.withColumn("_valid", F.col("held_out")))

    @property
    def _extra(self):
        return [f"proba_{i}" for i in range(STAGE_ONE_CLASSES)] if self.settings.use_stage_one else []

    def _with_first(self, df: DataFrame) -> DataFrame:
        scored = self.one.transform(self.encoder.transform(df)).withColumn("p1", vector_to_array("_p"))
        scored = scored.drop("features", "_p", "_raw", "_guess")
        return scored.select("*", *[F.get("p1", F.lit(i)).alias(f"proba_{i}") for i in range(STAGE_ONE_CLASSES)])

    def score(self, df: DataFrame) -> DataFrame:
        """Adds the probability arrays ``p1`` (three classes) and ``p2`` (two)."""
        second = self.two.transform(self.encoder.transform(self._with_first(df), self._extra))
        extra = [f"proba_{i}" for i in range(STAGE_ONE_CLASSES)]
        return (second.withColumn("p2", vector_to_array("probability"))
                .drop("features", "rawPrediction", "probability", "prediction", *extra))

    def importances(self, stage: int = 1) -> list[tuple[str, float]]:
        model, extra = (self.one, []) if stage == 1 else (self.two, self._extra)
        return [(n, float(v)) for n, v in zip(self.encoder.feature_names(extra), model.featureImportances.toArray())]


def average_probabilities(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the probability arrays of a row over folds or runs."""
    def mean(column, size):
        return F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(size)]).alias(column)
    return scored.groupBy(*keys).agg(mean("p1", 3), mean("p2", 2))


def decide(scored: DataFrame, out: str = "guess") -> DataFrame:
    return scored.withColumn(out, two_stage_label("p1", "p2"))


def cross_train(train: DataFrame, test: DataFrame | None, settings: Settings, keys: list[str],
                n_folds: int = 10, fold: str = "fold", parallelism: int = 4):
    """Train one two-stage model per fold, ``parallelism`` of them at a time.

    Returns ``(out_of_fold, test_mean, importance)``: each training row scored
    by the model that did not see it; test rows with fold-averaged
    probabilities (None without ``test``); ``(fold, stage, feature,
    importance)`` rows.
    """
    train = materialise(train, "train")
    test = materialise(test, "test") if test is not None else None

    def run(i):
        model = TwoStageModel(train.withColumn("held_out", F.col(fold) == i), settings)
        mine = model.score(train.filter(F.col(fold) == i)).select(*keys, "label", fold, "p1", "p2")
        scored = model.score(test).select(*keys, "p1", "p2") if test is not None else None
        return mine, scored, [(i, stage, n, v) for stage in (1, 2) for n, v in model.importances(stage)]

    with ThreadPool(min(parallelism, n_folds)) as pool:
        results = pool.map(inheritable_thread_target(train.sparkSession)(run), range(n_folds))
    held = union_all([mine for mine, _, _ in results])
    tests = union_all([scored for _, scored, _ in results]) if test is not None else None
    importance = [row for _, _, rows in results for row in rows]
    table = train.sparkSession.createDataFrame(
        importance, "fold int, stage int, feature string, importance double")
    return decide(held), (average_probabilities(tests, keys) if tests is not None else None), table
