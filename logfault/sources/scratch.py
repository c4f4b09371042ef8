"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and the
    rows survive the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to the shared folder like :func:`materialise`, but keep the rows in
    their partitions and order, which samplers with a seed depend on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Frames made inside leave no shuffle files behind when they have been
    computed (from Spark 4.1; before, they stay until the driver collects its garbage)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_written: list[str] = []


def scratch_mark() -> int:
    """A mark for :func:`drop_scratch`: what is written later lies behind it."""
    return len(_written)


def drop_scratch(spark: SparkSession, since: int = 0, keep_last: bool = False) -> int:
    """Remove the folders that were asked for in this process, those behind the mark ``since``.

    To be called when no frame that reads them is needed any more, but for
    the last one with ``keep_last``; returns the number of folders removed.
    """
    return drop_paths(spark, scratch_since(since)[:-1 if keep_last else None])


def scratch_since(mark: int) -> list[str]:
    """The folders asked for behind a :func:`scratch_mark`."""
    return _written[mark:]


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Remove these folders of :func:`scratch_path`; returns the number of folders removed."""
    _written[:] = [p for p in _written if p not in paths]
    removed = 0
    for name in reversed(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed
