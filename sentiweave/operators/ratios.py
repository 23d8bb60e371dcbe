"""Sentiment shares by any grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiweave.schema import require_columns


def sentiment_ratios(df: DataFrame, group_columns: list[str]) -> DataFrame:
    """Positive share and row count per group, in group order.

    A null label is left out of the share but counted as a row.
    """
    require_columns(df, ["sentiment_label", *group_columns])
    positive = (F.col("sentiment_label") == 1).cast("double")
    return (
        df.groupBy(*group_columns)
        .agg(F.avg(positive).alias("positive_ratio"), F.count("*").alias("count"))
        .orderBy(*group_columns)
    )
