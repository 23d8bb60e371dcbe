"""Selection of a decision threshold on F1, from counts taken in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiweave.functions.numeric import ratio


def f1_by_threshold(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, n_rows, precision, recall and f1 of class 1, guessed where ``score`` is at least the threshold.

    Rows meet the thresholds inside of the task; only counts are shuffled.
    """
    steps = F.array(*map(F.lit, sorted(set(thresholds))))
    rows = df.select(F.col(label).alias("_y"), F.col(score).alias("_s"), F.explode(steps).alias("threshold"))
    truth, guess = F.col("_y") == 1, F.col("_s") >= F.col("threshold")
    tp, fp, fn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)
    zero = F.lit(0.0)
    return rows.groupBy("threshold").agg(
        F.count("*").alias("n_rows"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def select_threshold(measured: DataFrame, metric: str = "f1", largest: bool = False) -> float:
    """The threshold with the best metric; of equal ones the smallest, or the ``largest``."""
    order = F.desc("threshold") if largest else F.asc("threshold")
    found = measured.orderBy(F.desc(metric), order).first()  # a row for each threshold
    if found is None:
        raise ValueError("no rows to select a threshold on")
    return found["threshold"]
