"""Rounding, guarded ratios and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double."""
    scale = float(10**digits)
    return F.rint(value.cast("double") * scale) / scale


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, null when ``whole`` is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def epoch_to_timestamp(seconds: Column) -> Column:
    """Unix seconds (fractions allowed) to a timestamp."""
    return F.timestamp_seconds(seconds)


def with_softmax(df: DataFrame, logits: str, output: str = "probabilities") -> DataFrame:
    """Add the softmax of an array column. Staged so that each exp runs once per row."""
    shifted = F.array_max(F.col(logits))
    return (
        df.withColumn("_top", shifted.cast("double"))
        .withColumn("_exp", F.transform(logits, lambda x: F.exp(x.cast("double") - F.col("_top"))))
        .withColumn("_sum", F.aggregate("_exp", F.lit(0.0), lambda a, x: a + x))
        .withColumn(output, F.transform("_exp", lambda x: x / F.col("_sum")))
        .drop("_top", "_exp", "_sum")
    )


def prediction_columns(probabilities: Column) -> dict[str, Column]:
    """Label (first class on a tie), probability of class 1, and confidence."""
    return {
        "sentiment_label": (
            F.array_position(probabilities, F.array_max(probabilities)) - 1
        ).cast("int"),
        "sentiment_score": F.get(probabilities, F.lit(1)),
        "confidence": F.array_max(probabilities),
    }
