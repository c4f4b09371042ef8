"""URL filters: rules first, then logistic regression on character n-grams of host and path.

A rule names a host and a beginning of the path; it holds for the host and all
its subdomains, and of the rules that fit the longest decides. Where none
fits, a model decides that was trained on a small table of labelled URLs:
runs of 3 to 5 characters of the host and of the path, digits alike, are
hashed to coordinates of one sparse binary vector. All of it runs on the JVM,
a row at a time; nothing but the bounded sample of labelled rows is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Coordinates of the hashed vector.
COORDINATES = 1 << 18
GRAMS = (3, 4, 5)
#: Labelled rows that training reads at most, those with the smallest hash of their URL.
SAMPLE = 5_000
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What lies between ``://`` and the next of ``/?#``, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, null if none does.

    Rules are a list of the job. Equal lengths: the longer host, then block
    before allow.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == BLOCK)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Marked character n-grams; a look-ahead finds them in one pass over the text.

    An empty host or path is one gram of its own, and one gram is in every
    row. It stands for the intercept, which no penalty holds: a single URL
    without grams would set it and all URLs of few known grams with it.
    """
    def of(text: Column, mark: str) -> list[Column]:
        framed = F.regexp_replace(F.concat(F.lit("^"), text, F.lit("$")), "[0-9]", "0")
        return [F.transform(F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)),
                            lambda g: F.concat(F.lit(mark), g)) for n in GRAMS]
    def none(text: Column, mark: str) -> Column:
        return F.when(text == "", F.array(F.lit(f"{mark}^$"))).otherwise(F.array().cast("array<string>"))
    return F.concat(*of(host, "h"), none(host, "h"), *of(path, "p"), none(path, "p"), F.array(F.lit("all")))


def _vectors(df: DataFrame, host: Column, path: Column) -> DataFrame:
    hashed = HashingTF(numFeatures=COORDINATES, binary=True, inputCol="_grams", outputCol="_features")
    return hashed.transform(df.withColumn("_grams", grams(host, path)))


def train(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", sample: int = SAMPLE) -> LogisticRegressionModel | None:
    """A model of P(block) from labelled URLs, or None without any.

    At most ``sample`` distinct labelled rows are read, those with the
    smallest hash of their URL, in that order and in one partition, so that
    equal tables give equal models. Null URLs count as empty; rows with
    another verdict than allow or block teach nothing.
    """
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    rows = (labelled.select(url.alias("url"), (F.col(f"`{verdict_col}`") == BLOCK).cast("double").alias("y"),
                            F.col(f"`{verdict_col}`").alias("verdict"))
            .filter(F.col("verdict").isin(ALLOW, BLOCK)).drop("verdict").distinct()
            .orderBy(F.xxhash64("url"), "url", "y").limit(sample))
    rows = materialise(_vectors(rows, host_of(F.col("url")), path_of(F.col("url"))).select("_features", "y"), "labelled")
    if not rows.take(1):
        return None
    one = rows.coalesce(1)  # at most ``sample`` rows
    return LogisticRegression(featuresCol="_features", labelCol="y", regParam=1e-3, maxIter=60, standardization=False,
                              fitIntercept=False).fit(one)


def filtered(df: DataFrame, model: LogisticRegressionModel | None, rules: Sequence[Rule], id_col: str = "page_id",
             url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``df``.

    ``score`` is the model's P(block); without a model it is null and rows
    without a rule are allowed. A null URL, or one without ``://``, has an
    empty host and path. Repeated rows are judged alike; columns other than
    id and url are not read.
    """
    url = F.col(f"`{url_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        rows = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        model = model.copy().setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
        rows = model.transform(_vectors(rows, F.col("host"), F.col("path"))).withColumn("score", vector_to_array("_p")[1])
    guessed = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                       F.coalesce("_rule.verdict", guessed).alias("verdict"), "score")


def by_rules(df: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """A labelled table, ``url, verdict``: the URLs of ``df`` that a rule decides."""
    url = F.col(f"`{url_col}`").cast("string")
    judged = df.select(url.alias("url"), longest_rule(host_of(url), path_of(url), rules)["verdict"].alias("verdict"))
    return judged.filter(F.col("verdict").isNotNull())
