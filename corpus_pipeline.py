"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage works on all that its predecessor kept and all but the last return
the columns of ``documents``. What a stage has written for itself goes when
the next one starts, whoever runs them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logfault.llm.near_copies import first_of_near_copies
from logfault.llm.packing import pack
from logfault.llm.queries import ID_VOCABULARY, vocabulary
from logfault.llm.secrets import without_secrets
from logfault.llm.suffix_dedup import without_repeats
from logfault.llm.toxicity import without_toxic
from logfault.sources.scratch import drop_paths, drop_scratch, materialise, scratch_mark, scratch_since

#: The scratch folders that the results of earlier stages may still read.
_left: list[str] = []


def _clears_up(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, after the removal of what earlier stages have written and its own input no longer reads."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = docs.inputFiles()  # the result of the stage before, or all it is made from if nobody has written it
            gone = [p for p in _left if not any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)]
            drop_paths(spark, gone)
            _left[:] = [p for p in _left if p not in gone]
        mark = scratch_mark()
        out = stage(spark, docs, sf_dir)
        _left.extend(scratch_since(mark))
        return out
    return run_stage


@_clears_up
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_clears_up
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: Jaccard of 0.8 or more over shingles of five words."""
    return first_of_near_copies(docs)


#: Words of a passage that may not repeat: over 50.
PASSAGE_WORDS = 51


@_clears_up
def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of over 50 words are cut out of the texts; every document stays.

    Where 400 bytes may hold no more than 50 words, it is passages of 400 bytes.
    """
    return without_repeats(docs, words=PASSAGE_WORDS)


@_clears_up
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return without_secrets(docs)


@_clears_up
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document with their places in sequences."""
    return pack(docs, vocabulary(ID_VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Trained weights, suffix arrays and packing are beyond SQL; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; what a stage has written goes once its result is written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, mark, keep_last=True)
    return docs
