"""Binary classification metrics, range checks and table audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.functions.numeric import ratio
from sentiweave.schema import require_columns

METRICS = ("accuracy", "precision", "recall", "f1")

# Allowed ranges of prediction columns.
PREDICTION_RANGES = {
    "sentiment_label": (0, 1),
    "sentiment_score": (0, 1),
    "confidence": (0, 1),
}


# Columns of a corpus row that must hold a value.
CORPUS_REQUIRED = ("text", "lang", "source", "topic")


def predicted_class(logits: Column) -> Column:
    """Index of the largest logit, the first one on a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def binary_metrics(
    df: DataFrame, label: str, prediction: str, by: list[str] | None = None
) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1 (0 where undefined)."""
    by = by or []
    truth, guess = F.col(label) == 1, F.col(prediction) == 1

    def rows(condition: Column) -> Column:
        return F.count_if(condition)

    tp, fp, fn = rows(truth & guess), rows(~truth & guess), rows(truth & ~guess)
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        ratio(rows(F.col(label) == F.col(prediction)), F.count("*")).alias("accuracy"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def metrics_long(metrics: DataFrame, language: str = "language") -> DataFrame:
    """``(metric, value)`` rows named ``val_{language}_eval_{metric}``."""
    pairs = F.array(
        *(F.struct(F.lit(m).alias("name"), F.col(m).alias("value")) for m in METRICS)
    )
    return metrics.select(language, F.inline(pairs)).select(
        F.concat(F.lit("val_"), F.col(language), F.lit("_eval_"), F.col("name")).alias("metric"),
        "value",
    )


def range_violations(
    df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """``(rule, violations)``: values that are missing or outside each closed range, in one pass."""
    ranges = PREDICTION_RANGES if ranges is None else ranges
    require_columns(df, ranges)
    counts = df.agg(
        *(
            F.count_if(F.col(c).isNull() | ~F.col(c).between(low, high)).alias(c)
            for c, (low, high) in ranges.items()
        )
    )
    rows = F.array(
        *(F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in ranges)
    )
    return counts.select(F.inline(rows))


def audit_source(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """One row: rows found and the required columns that are missing."""
    missing = [c for c in required if c not in df.columns]
    problems = F.lit(", ".join(f"missing column {c}" for c in missing))
    rows = F.count("*")
    return df.agg(rows.alias("n_rows")).select(
        F.lit(name).alias("source"),
        "n_rows",
        problems.alias("errors"),
        ((F.col("n_rows") > 0) & F.lit(not missing)).alias("ok"),
    )


def audit_sources(
    sources: dict[str, tuple[DataFrame | Callable[[], DataFrame], list[str]]],
) -> DataFrame:
    """``audit_source`` over several sources.

    A source may be a function that loads it: one that can't be loaded becomes a row with
    the error's class, and the audit goes on.
    """
    found, failed = [], []
    for name, (source, required) in sources.items():
        try:
            df = source() if callable(source) else source
        except (PySparkException, OSError, ValueError) as error:
            failed.append((name, 0, f"cannot load: {type(error).__name__}", False))
            continue
        found.append(audit_source(df, name, required))
    if failed:
        schema = "source string, n_rows long, errors string, ok boolean"
        found.append(SparkSession.active().createDataFrame(failed, schema))
    return reduce(DataFrame.unionByName, found)


def missing_values(df: DataFrame, required: Sequence[str] = CORPUS_REQUIRED) -> DataFrame:
    """``(column, missing)``: rows without a value in each required column, in one pass."""
    require_columns(df, required)
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in required))
    return counts.select(F.inline(rows))
