"""Fit, select and evaluate a sentiment classifier as a Spark ML pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiweave.functions.text import MAX_SEQUENCE_LENGTH, WHITESPACE, WORDS, WS, Tokenizer
from sentiweave.operators.metrics import binary_metrics, metrics_long
from sentiweave.sources.corpora import append_metrics
from sentiweave.sources.registry import SEED


#: Column that fitted pipelines read; it can't clash with the columns of a corpus.
TEXT = "_scored_text"


@dataclass(frozen=True)
class TrainingOptions:
    """Settings of a fit. The number of features bounds the model, not the vocabulary."""

    features: int = 1 << 16
    max_iterations: int = 20
    regularization: tuple[float, ...] = (0.01,)
    folds: int = 2
    seed: int = SEED
    tags: dict[str, str] = field(default_factory=dict)


def _features(options: TrainingOptions) -> list:
    # A SQL expression runs in codegen; the ML tokenizers are per-row functions.
    # A missing text is an empty one.
    words = f"split(btrim(lower(coalesce({TEXT}, '')), '{WHITESPACE}'), r'{WS}+')"
    return [
        SQLTransformer(statement=f"SELECT *, {words} AS _tokens FROM __THIS__"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=options.features),
        IDF(inputCol="_counts", outputCol="features"),
    ]


def tokenized(
    df: DataFrame,
    tokenizer: Tokenizer = WORDS,
    limit: int = MAX_SEQUENCE_LENGTH,
    vocabulary: int = 1 << 16,
) -> DataFrame:
    """``input_ids, attention_mask, labels`` of ``text, label`` rows, for an outside model.

    Ids are the first 32 bits of a token's md5, modulo ``vocabulary``; no other column is kept.
    """
    tokens = df.select(
        F.slice(tokenizer.split(F.col("text")), 1, limit).alias("_tokens"), "label"
    )
    return tokens.select(
        F.transform("_tokens", lambda t: _token_id(t, vocabulary)).alias("input_ids"),
        F.transform("_tokens", lambda t: F.lit(1)).alias("attention_mask"),
        F.col("label").alias("labels"),
    )


def word_ids(text: Column, vocabulary: int = 1 << 16) -> Column:
    """Ids of all words of a text, as in :func:`tokenized`."""
    return F.transform(WORDS.split(text), lambda t: _token_id(t, vocabulary))


def _token_id(token: Column, vocabulary: int) -> Column:
    code = F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 1, 8), 16, 10).cast("long")
    return F.pmod(code, F.lit(vocabulary)).cast("int")


def fit_classifier(
    train: DataFrame, options: TrainingOptions = TrainingOptions(), id_column: str | None = None
) -> PipelineModel:
    """Fit on ``text, label`` rows of all languages together.

    With more than one regularization value the best F1 of class 1 over the folds wins; folds
    follow a hash of the id (or text), so they do not depend on partitioning.
    """
    fold_key = F.col(id_column) if id_column else F.col("text")
    rows = train.select(
        F.col("text").alias(TEXT),
        F.col("label").cast("double").alias("label"),
        F.pmod(F.xxhash64(fold_key, F.lit(options.seed)), F.lit(options.folds))
        .cast("int")
        .alias("_fold"),
    )
    tokens, counts, idf = _features(options)
    # Word counts are kept: the IDF pass and every solver pass start from them.
    counted = counts.transform(tokens.transform(rows)).select("_counts", "label", "_fold").persist()
    try:
        weights = idf.fit(counted)
        vectors = weights.transform(counted).select("features", "label", "_fold")
        solver = LogisticRegression(
            maxIter=options.max_iterations, regParam=options.regularization[0]
        )
        if len(options.regularization) == 1:
            classifier = solver.fit(vectors)
        else:
            grid = ParamGridBuilder().addGrid(solver.regParam, list(options.regularization))
            f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
            classifier = (
                CrossValidator(
                    estimator=solver,
                    estimatorParamMaps=grid.build(),
                    evaluator=f1,
                    numFolds=options.folds,
                    foldCol="_fold",
                    parallelism=4,
                )
                .fit(vectors)
                .bestModel
            )
    finally:
        counted.unpersist()
    return PipelineModel([tokens, counts, weights, classifier])


def score(model: PipelineModel, df: DataFrame, text_column: str = "text") -> DataFrame:
    """Input columns plus ``probabilities`` (array of class probabilities)."""
    scored = model.transform(df.withColumn(TEXT, F.col(text_column)))
    return scored.select(
        *df.columns, vector_to_array(F.col("probability")).alias("probabilities")
    )


def evaluate(
    model: PipelineModel, validation: DataFrame, by: str = "language"
) -> DataFrame:
    """Metrics per language in long form."""
    guess = score(model, validation).withColumn(
        "_guess", (F.get("probabilities", F.lit(1)) > F.get("probabilities", F.lit(0))).cast("int")
    )
    return metrics_long(binary_metrics(guess, "label", "_guess", [by]), by)


def train_job(
    train: DataFrame,
    validation: DataFrame,
    output_dir: str,
    run: str,
    options: TrainingOptions = TrainingOptions(),
    id_column: str | None = None,
) -> str:
    """Fit, evaluate per language, append parameters and metrics, export ``best``."""
    spark = train.sparkSession
    model = fit_classifier(train, options, id_column)
    parameters = spark.createDataFrame(
        [
            ("features", float(options.features)),
            ("max_iterations", float(options.max_iterations)),
            ("regularization", float(model.stages[-1].getRegParam())),
        ],
        "metric string, value double",
    )
    metrics_path = f"{output_dir.rstrip('/')}/metrics"
    rows = train.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("train_rows").alias("metric"), "value"
    )
    append_metrics(parameters.unionByName(rows), metrics_path, run, "parameters")
    append_metrics(evaluate(model, validation), metrics_path, run, "validation")
    best = f"{output_dir.rstrip('/')}/best"
    model.write().overwrite().save(best)
    return best
