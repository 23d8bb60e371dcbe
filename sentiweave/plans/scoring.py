"""Batch scoring: attach label, score and confidence to every row of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiweave.functions.numeric import prediction_columns, with_softmax
from sentiweave.plans.training import score
from sentiweave.schema import require_columns
from sentiweave.sources.corpora import load_corpus_table, save_predictions

# A scorer adds ``probabilities`` (array<double>) to a frame and keeps its columns.
Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(model: PipelineModel, text_column: str = "text") -> Scorer:
    """Score with a fitted pipeline, JVM-side."""

    def run(df: DataFrame) -> DataFrame:
        return score(model, df, text_column)

    return run


def logits_scorer(logits: str) -> Scorer:
    """Score from a column of raw logits."""
    return lambda df: with_softmax(df, logits)


def external_scorer(
    load: Callable[[], Callable[[list[str]], list[list[float]]]],
    text_column: str = "text",
    batch_size: int = 32,
) -> Scorer:
    """Score with an outside model, called on lists of ``batch_size`` texts.

    ``load`` runs once per task, never per row; text reaches it in Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = (texts[i : i + batch_size] for i in range(0, len(texts), batch_size))
            yield pd.Series([row for part in parts for row in predict(part)], dtype=object)

    return lambda df: df.withColumn("probabilities", probabilities(F.col(text_column)))


def predict_corpus(df: DataFrame, scorer: Scorer, text_column: str = "text") -> DataFrame:
    """All input columns plus ``sentiment_label``, ``sentiment_score``, ``confidence``."""
    require_columns(df, [text_column, "lang", "topic"])
    return (
        scorer(df)
        .withColumns(prediction_columns(F.col("probabilities")))
        .drop("probabilities")
    )


def predict_job(
    spark: SparkSession, input_path: str, output_path: str, scorer: Scorer
) -> str:
    """Read a corpus, score it, write predictions. An empty corpus is an error."""
    df = load_corpus_table(spark, input_path)
    if df.isEmpty():
        raise ValueError(f"No rows to score in {input_path}")
    return save_predictions(predict_corpus(df, scorer), output_path)
