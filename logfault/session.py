"""Session settings shared by the bench, the tests and the stages."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "logfault", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tuned for.

    Adaptive execution stays on: it coalesces small shuffles, splits skewed
    join partitions and turns a join into a broadcast when the measured side
    is under Spark's own threshold.
    """
    builder = SparkSession.builder.appName(app)
    # Python workers of a local session import the library from here, whatever the working directory.
    builder = builder.config("spark.executorEnv.PYTHONPATH", _ROOT)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors of a running session, for clusters on which it is not installed."""
    folder = tempfile.mkdtemp(prefix="logfault-code-")  # Spark copies the archive from the driver
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/logfault", "zip", _ROOT, "logfault"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage, so a checkpoint
    outlives a lost executor. Only a local session may fall back to a scratch
    folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="logfault-checkpoint-")
    context.setCheckpointDir(folder)
