"""Frame schemas and the checks made on them before a job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("community", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("post_id", T.StringType()),
    ]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df``, or raise if any of ``columns`` is not in it."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def as_corpus(df: DataFrame) -> DataFrame:
    """Project and cast to the corpus schema, so that corpora stack whatever their types."""
    require_columns(df, CORPUS_SCHEMA.fieldNames())
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CORPUS_SCHEMA))
