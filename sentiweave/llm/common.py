"""What the operators share: tables, the shared folder, Arrow batches, text keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentiweave.session import shared_folder

#: Rows that a Python step holds as objects at a time; bounds memory for long texts.
ROWS_AT_A_TIME = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read from there from now on."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` in tasks, where each Python worker unpacks it once.

    Packed with the job's own pickler: executors need no copy of this package.
    """
    held = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})

    def get() -> object:
        found = held.value
        if "value" not in found:
            found["value"] = cloudpickle.loads(found.pop("packed"))
        return found["value"]

    return get


def plus(schema: StructType, fields: str) -> StructType:
    """A schema with fields more, given as in DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(fields).fields])


def written(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, by a Parquet table in the shared folder (smaller, columnar)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(
    df: DataFrame, schema: str | StructType, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """``rows`` over slices of at most ROWS_AT_A_TIME rows, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                out = rows(batch.slice(start, ROWS_AT_A_TIME))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    The optimizer writes an expression into every place that uses its column, inside of
    lambdas too; a lambda's own variable stays as it is.
    """
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)


def hash_pair(value: Column) -> Column:
    """128 bits of hash of a text as two longs: a key for whole corpora."""
    return F.struct(
        F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b")
    )
