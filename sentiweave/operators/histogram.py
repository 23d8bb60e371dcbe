"""Value histograms and what can be read off them: quantiles, bins, box plots.

Every statistic here starts from ``groupBy(value).count()``. The running counts are
then taken over distinct values, never over rows, so a hot group costs as many rows
as it has different lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, by: list[str], value: str | Column) -> DataFrame:
    """``(by, value, n)``: how often each value occurs."""
    column = F.col(value) if isinstance(value, str) else value
    return df.select(*by, column.alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))


def with_running_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Add ``upto`` (rows with a value not above this one) and ``total``."""
    whole = Window.partitionBy(*by)
    sofar = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("upto", F.sum("n").over(sofar)).withColumn(
        "total", F.sum("n").over(whole)
    )


def at_rank(rank: Column, value: str = "value", upto: str = "upto") -> Column:
    """Aggregate: the value at a 0-based rank of the sorted rows."""
    return F.min(F.when(F.col(upto) > rank, F.col(value)))


def floor_quantile(q: float) -> Column:
    """Aggregate over running counts: the value at rank ``floor(q * (n - 1))``."""
    return at_rank(F.floor(F.lit(q) * (F.col("total") - 1)))


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Floor-index quantiles per group, one column per entry of ``qs``."""
    running = with_running_counts(value_counts(df, by, value), by)
    return running.groupBy(*by).agg(
        *(floor_quantile(q).cast("double").alias(name) for name, q in qs.items())
    )


def length_histogram(df: DataFrame, by: list[str], value: str, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins per group; the last bin is closed, empty bins are absent.

    A group with a single value uses the range value ± 0.5.
    """
    whole = Window.partitionBy(*by)
    low, high = F.col("low"), F.col("high")
    ranged = (
        value_counts(df, by, value)
        .withColumn("low", F.min("value").over(whole).cast("double"))
        .withColumn("high", F.max("value").over(whole).cast("double"))
        .withColumn("flat", low == high)
        .withColumn("low", F.when(F.col("flat"), low - 0.5).otherwise(low))
        .withColumn("high", F.when(F.col("flat"), high + 0.5).otherwise(high))
    )
    place = F.floor((F.col("value") - low) / (high - low) * bins)
    return (
        ranged.withColumn("bin", F.least(place, F.lit(bins - 1)))
        .groupBy(*by, "bin", "low", "high")
        .agg(F.sum("n").alias("count"))
        .select(
            *by,
            "bin",
            (low + (high - low) * F.col("bin") / bins).alias("bin_start"),
            (low + (high - low) * (F.col("bin") + 1) / bins).alias("bin_end"),
            "count",
        )
    )


def boxplot_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Interpolated quartiles, whiskers within 1.5 IQR, and the rows beyond them."""
    whole = Window.partitionBy(*by)
    running = with_running_counts(value_counts(df, by, value), by)

    def quartile(q: float) -> Column:
        spot = F.lit(q) * (F.col("total") - 1)
        below = at_rank(F.floor(spot)).over(whole)
        above = at_rank(F.ceil(spot)).over(whole)
        return below + (above - below) * (spot - F.floor(spot))

    boxed = running.withColumns(
        {"q1": quartile(0.25), "median": quartile(0.5), "q3": quartile(0.75)}
    ).withColumn("reach", (F.col("q3") - F.col("q1")) * 1.5)
    inside = F.col("value").between(F.col("q1") - F.col("reach"), F.col("q3") + F.col("reach"))
    return boxed.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
    )
