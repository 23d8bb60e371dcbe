"""Splits of labelled corpora as files in id order, so that a head reads its own files alone.

A split is written in ranges of the id, a file for each, and beside them a small table with
every file's lowest and highest id and its rows. ``split[:N]`` takes from this table the files
that can hold one of the first N ids; the others aren't opened. Splits that have landed
without such a table get it from one pass over their id column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentiweave.operators.sampling import first_n

RANGES = "_ranges"
ROWS_PER_FILE = 1_000_000


def parse_slice(slice_: str) -> tuple[str, int | None]:
    """Name and row count of ``split`` or ``split[:N]``."""
    match = re.fullmatch(r"(\w+)(?:\[:(\d+)\])?", slice_)
    if match is None:
        raise ValueError(f"Unsupported split slice: {slice_!r}")
    return match[1], None if match[2] is None else int(match[2])


def file_ranges(df: DataFrame, id_column: str) -> DataFrame:
    """file (its name), low, high and rows of every file of a Parquet folder."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(id_column).alias("low"), F.max(id_column).alias("high"), F.count("*").alias("rows")
    )


def write_split(df: DataFrame, path: str, split: str, id_column: str, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write one split of a corpus in id order, nulls last, with the table of its files."""
    folder = f"{path.rstrip('/')}/split={split}"
    files = max(1, -(-df.count() // rows_per_file))
    order = F.col(id_column).asc_nulls_last()
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(folder)
    found = file_ranges(df.sparkSession.read.schema(df.schema).parquet(folder), id_column)
    found.coalesce(1).write.parquet(f"{folder}/{RANGES}")
    return folder


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def head_files(ranges: DataFrame, n: int) -> list[str]:
    """The files that can hold one of the first ``n`` rows in id order; ids without value come last."""
    last = Window.orderBy(F.col("high").asc_nulls_last(), "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a file: a small table, whatever the files hold.
    full = ranges.withColumn("upto", F.sum("rows").over(last)).where(F.col("upto") >= n)
    edge = full.orderBy("upto").select("high").first()
    if edge is None or edge["high"] is None:
        return [r["file"] for r in ranges.collect()]
    return sorted(r["file"] for r in ranges.where(F.col("low") <= edge["high"]).collect())


def read_slice(spark: SparkSession, path: str, slice_: str, id_column: str) -> DataFrame:
    """``split`` or ``split[:N]`` of the corpus at ``path``; N counts rows in id order."""
    split, n = parse_slice(slice_)
    folder = f"{path.rstrip('/')}/split={split}"
    whole = spark.read.option("basePath", path).parquet(folder)
    if n is None:
        return whole
    if n == 0:
        return whole.limit(0)
    if _exists(spark, f"{folder}/{RANGES}"):
        ranges = spark.read.parquet(f"{folder}/{RANGES}")
    else:
        ranges = file_ranges(whole, id_column)
    files = [f"{folder}/{name}" for name in head_files(ranges, n)]
    if not files:
        return whole
    return first_n(spark.read.schema(whole.schema).option("basePath", path).parquet(*files), n, id_column)
