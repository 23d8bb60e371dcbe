"""Two-sided Mann-Whitney U test over any number of sample pairs at once."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Samples up to this size without ties get the exact distribution.
EXACT_MAX_SAMPLE = 8
_QUOTIENTS: dict[int, list[int]] = {}
_SLICES = 2_048


def _quotient(parts: list[int], period: int) -> list[int]:
    """Coefficients of the product of (1 - q^period) / (1 - q^part) over the parts."""
    out = [1]
    for part in parts:
        wide = [0] * (len(out) + period - part)
        for start in range(0, period, part):
            for i, x in enumerate(out):
                wide[start + i] += x
        out = wide
    return out


def _partitions(total: int, parts: list[int], period: int, quotient: list[int]) -> int:
    """In how many ways ``total`` is a sum of the parts, each used any number of times.

    1 / prod(1 - q^part) is quotient / (1 - q^period)^len(parts), whose coefficients are
    binomials: a few of them are summed, however large ``total`` is.
    """
    places = range(total % period, min(total, len(quotient) - 1) + 1, period)
    size = len(parts) - 1
    return sum(quotient[i] * math.comb((total - i) // period + size, size) for i in places)


def exact_p(u: float, n_a: int, n_b: int) -> float:
    """Two-sided exact p-value for samples without ties, the smaller of EXACT_MAX_SAMPLE at most.

    The arrangements with U = k are the coefficients of a Gaussian binomial,
    prod (1 - q^(large + i)) / (1 - q^i) for i = 1..small. One more factor 1 / (1 - q) sums
    them up to k; the numerator has 2^small terms.
    """
    small, large = min(n_a, n_b), max(n_a, n_b)
    upto = int(min(u, n_a * n_b - u))
    parts = [1, *range(1, small + 1)]
    period = math.lcm(*parts)
    quotient = _quotient_of(small)
    terms = {0: 1}  # exponent -> coefficient of the numerator
    for i in range(1, small + 1):
        more = dict(terms)
        for power, sign in terms.items():
            if power + large + i <= upto:
                more[power + large + i] = more.get(power + large + i, 0) - sign
        terms = more
    ways = sum(sign * _partitions(upto - power, parts, period, quotient) for power, sign in terms.items())
    return min(1.0, 2 * ways / math.comb(n_a + n_b, n_a))


def _quotient_of(small: int) -> list[int]:
    """Computed once per process for each of the few sizes."""
    if small not in _QUOTIENTS:
        parts = [1, *range(1, small + 1)]
        _QUOTIENTS[small] = _quotient(parts, math.lcm(*parts))
    return _QUOTIENTS[small]


@F.pandas_udf(T.DoubleType())
def _p_value(
    u: pd.Series, z: pd.Series, n_a: pd.Series, n_b: pd.Series, ties: pd.Series
) -> pd.Series:
    def one(u: float, z: float, a: int, b: int, tied: float) -> float | None:
        if not a or not b or math.isnan(u):
            return None
        if tied == 0 and min(a, b) <= EXACT_MAX_SAMPLE:
            return exact_p(u, int(a), int(b))
        # All values equal: no evidence either way.
        return 1.0 if math.isnan(z) else min(1.0, math.erfc(z / math.sqrt(2)))

    return pd.Series([one(*row) for row in zip(u, z, n_a, n_b, ties)], dtype="float64")


def _slicer(df: DataFrame, value: str) -> Bucketizer | None:
    """Slices of the value range with about equal row counts, from a one-pass sketch.

    The split points only balance the work; the result does not depend on them.
    """
    probabilities = [i / _SLICES for i in range(1, _SLICES)]
    rows = df.select(F.col(value).cast("double").alias("value"))
    splits = rows.stat.approxQuantile("value", probabilities, 1 / (2 * _SLICES))
    inner = sorted({s for s in splits if math.isfinite(s)})
    if not inner:
        return None
    edges = [-math.inf, *inner, math.inf]
    return Bucketizer(splits=edges, inputCol="value", outputCol="_slice", handleInvalid="keep")


def _u_statistics(counts: DataFrame, by: list[str], slicer: Bucketizer | None) -> DataFrame:
    """U, z and sizes per group from ``(by, value, _a, _b)`` counts per distinct value.

    Ranks need the number of smaller rows. That is a running sum inside one slice of
    the value range plus the size of all lower slices, so no task ever sorts a whole
    test. Only sums per slice cross the second window.
    """
    part = "_slice"
    sliced = slicer.transform(counts) if slicer else counts.withColumn(part, F.lit(0.0))
    here = Window.partitionBy(*by, part).orderBy("value")
    below = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, t = F.col("_a").cast("double"), (F.col("_a") + F.col("_b")).cast("double")
    per_slice = (
        sliced.withColumn("_t", t)
        .withColumn("_lower", F.sum("_t").over(below) - F.col("_t"))
        .groupBy(*by, part)
        .agg(
            F.sum(a * (F.col("_lower") + (F.col("_t") + 1) / 2)).alias("_rank"),
            F.sum("_a").alias("_a"),
            F.sum("_b").alias("_b"),
            F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"),
            F.max(F.isnan("value").cast("int")).alias("_nan"),
        )
    )
    sofar = Window.partitionBy(*by).orderBy(part).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    size = F.col("_a") + F.col("_b")
    ranked = per_slice.withColumn("_offset", F.sum(size).over(sofar) - size)
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.col("_nan") == 0)
    u = F.col("_rank") - n_a * (n_a + 1) / 2
    variance = n_a * n_b / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    gap = F.greatest(F.col("u"), n_a * n_b - F.col("u")) - n_a * n_b / 2 - 0.5
    return (
        ranked.groupBy(*by)
        .agg(
            F.sum("_a").alias("n_a"),
            F.sum("_b").alias("n_b"),
            F.sum(F.col("_rank") + F.col("_offset") * F.col("_a")).alias("_rank"),
            F.sum("_ties").alias("ties"),
            F.max("_nan").alias("_nan"),
        )
        .withColumn("u", F.when(both, u))
        .withColumn("_variance", F.when(both, variance))
        .withColumn("z", F.when(F.col("_variance") > 0, gap / F.sqrt("_variance")))
        .withColumn("p_value", _p_value("u", "z", "n_a", "n_b", "ties"))
        .select(*by, "n_a", "n_b", "ties", "u", "z", "p_value")
    )


def _counts(df: DataFrame, value: str, keys: list[str], a: Column, b: Column) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("value"), a.alias("_a"), b.alias("_b"))
        .groupBy(*keys, "value")
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )


def mann_whitney(
    df: DataFrame, value: str, in_a: Column, by: list[str] | None = None
) -> DataFrame:
    """Test rows where ``in_a`` holds against the others, per group. U is that of A."""
    by = by or []
    a = in_a.cast("long")
    keys = by or ["_one"]
    rows = df if by else df.withColumn("_one", F.lit(0))
    counts = _counts(rows, value, keys, a, 1 - a)
    result = _u_statistics(counts, keys, _slicer(df, value))
    return result if by else result.drop("_one")


def mann_whitney_samples(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Test two single-column samples."""
    both = a.select(value, F.lit(True).alias("_in_a")).unionByName(
        b.select(value, F.lit(False).alias("_in_a"))
    )
    return mann_whitney(both, value, F.col("_in_a"))


def mann_whitney_pairs(
    df: DataFrame, value: str, sample: str, levels: list[str], by: list[str] | None = None
) -> DataFrame:
    """Test every pair of ``levels`` of the ``sample`` column, per group, in one job.

    Values are counted per level first; only the counts are then copied to the
    ``len(levels) - 1`` pairs each level takes part in.
    """
    by = by or []
    pairs = [
        F.struct(
            F.lit(a).alias("sample_a"),
            F.lit(b).alias("sample_b"),
        )
        for a, b in combinations(sorted(levels), 2)
    ]
    mine = F.filter(
        F.array(*pairs), lambda p: F.col(sample).isin(p["sample_a"], p["sample_b"])
    )
    counts = (
        df.where(F.col(value).isNotNull() & F.col(sample).isin(*levels))
        .groupBy(*by, sample, F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("_n"))
        .select(*by, sample, "value", "_n", F.inline(mine))
    )
    is_a = F.col(sample) == F.col("sample_a")
    keys = [*by, "sample_a", "sample_b"]
    tested = (
        counts.groupBy(*keys, "value")
        .agg(
            F.sum(F.when(is_a, F.col("_n")).otherwise(0)).alias("_a"),
            F.sum(F.when(is_a, 0).otherwise(F.col("_n"))).alias("_b"),
        )
    )
    return _u_statistics(tested, keys, _slicer(df, value))
