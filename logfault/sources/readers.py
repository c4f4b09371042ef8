"""Readers and writers: CSV or Parquet in, Parquet (or CSV) out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.lookup import counted_broadcast
from . import schemas

# File names per stage. Fixed values.
_LABEL_FILES = ["preliminary_train_label_dataset", "preliminary_train_label_dataset_s"]
_LOG_FILES = ["preliminary_sel_log_dataset", "preliminary_sel_log_dataset_a",
              "preliminary_sel_log_dataset_b"]
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
_FINAL_SUFFIX = {"final_a": "a", "final_b": "b"}


# Quotes inside quoted values are doubled, on read and on write.
_CSV = {"header": True, "timestampFormat": TIME_FORMAT, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, paths, schema, multi_line: bool = False) -> DataFrame:
    """CSV with a header line and a declared schema.

    ``multi_line`` allows line breaks inside quoted values; a file is then one
    split.
    """
    return spark.read.schema(schema).options(**_CSV, multiLine=multi_line).csv(paths)


def read_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**_CSV)
    return reader.load(path)


def stage_sources(stage: str | None) -> dict[str, list[str]]:
    """Which source names each table is stacked from in a given stage."""
    suffix = _FINAL_SUFFIX.get(stage or "")
    names = {
        "labels": list(_LABEL_FILES),
        "logs": list(_LOG_FILES),
        "submit": ["preliminary_submit_dataset_b"],
        "crashdump": ["preliminary_crashdump_dataset"],
        "venus": ["preliminary_venus_dataset"],
    }
    if suffix:
        names["logs"].append(f"final_sel_log_dataset_{suffix}")
        names["submit"] = [f"final_submit_dataset_{suffix}"]
        names["crashdump"].append(f"final_crashdump_dataset_{suffix}")
        names["venus"].append(f"final_venus_dataset_{suffix}")
    return names


def union_all(frames) -> DataFrame:
    """Stack tables by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def select_sources(tables: dict[str, DataFrame], stage: str | None, kind: str) -> DataFrame:
    """Stack the tables that belong to ``kind`` in ``stage``."""
    return union_all([tables[name] for name in stage_sources(stage)[kind]])


def read_stage(spark: SparkSession, folder: str, stage: str | None, kind: str,
               final_folder: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read one logical table of a stage from CSV files; logs get their ``row_id``."""
    schema = {"labels": schemas.LABELS, "logs": schemas.SYSTEM_LOG, "submit": schemas.SUBMIT,
              "crashdump": schemas.CRASHDUMP, "venus": schemas.VENUS}[kind]
    paths = [f"{(final_folder or folder) if name.startswith('final_') else folder}/{name}.csv"
             for name in stage_sources(stage)[kind]]
    if kind != "logs":
        return read_csv(spark, paths, schema, multi_line)
    return arrival_order([read_csv(spark, path, schema, multi_line) for path in paths])


def read_fold_files(spark: SparkSession, pattern: str) -> DataFrame:
    """All per-fold importance files in one read; the fold is the number
    before ``_imp`` in the file's path."""
    return (read_csv(spark, pattern, schemas.IMPORTANCE)
            .withColumn("fold", F.regexp_extract(F.input_file_name(), r"(\d+)_imp", 1).cast("int")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Overwrite ``path``; CSV gets a header and no row numbers."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(**_CSV)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def arrival_order(sources: list[DataFrame], name: str = "row_id") -> DataFrame:
    """Stack plain file scans and number their rows in order of arrival.

    Ids ascend by source (in the given order), path, and place in the file,
    however Spark packs and splits the files: the hidden metadata of a row name
    its file and the first byte of its block, and within a block rows keep
    their order. Blocks are ranked, one row each, and a row's id is the rank
    of its block and its place in the task. Ids are unique but have gaps.
    """
    marked = union_all([df.select(
        "*", F.struct(F.lit(i).alias("source"), F.col("_metadata.file_path").alias("path"),
                      F.col("_metadata.file_block_start").alias("start")).alias("_block"),
        F.monotonically_increasing_id().alias("_place")) for i, df in enumerate(sources)])
    order = Window.orderBy("_block")  # one row per block of a file
    blocks = marked.select("_block").distinct().withColumn("_rank", F.row_number().over(order).cast("bigint"))
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = marked.join(counted_broadcast(blocks), "_block").withColumn(name, F.shiftleft("_rank", 33) + place)
    return numbered.drop("_block", "_rank", "_place")


def add_arrival_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """:func:`arrival_order` of one scan."""
    return arrival_order([df], name)


def spread_scan(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    For costly per-row work on few or small files. A scan that already fills
    the cluster is returned as it is, so large inputs are never shuffled.
    Call it on a plain scan, before any join or aggregate.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
