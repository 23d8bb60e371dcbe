"""The inspection report: every table behind the corpus overview, from one stacked frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiweave.functions.text import WORDS, Tokenizer
from sentiweave.operators.histogram import boxplot_stats, length_histogram
from sentiweave.operators.profile import (
    eda_frame,
    label_distribution,
    quality_flags,
    stack_corpora,
    summarize_corpora,
    summary_rows,
    token_length_stats,
)
from sentiweave.operators.sampling import sample_rows
from sentiweave.sources.registry import CorpusSpec, registry_frame


def primary_length() -> Column:
    """Characters for Chinese, words elsewhere."""
    return F.when(F.col("language") == "zh", F.col("char_len")).otherwise(F.col("word_len"))


def corpus_report(
    corpora: dict[str, tuple[CorpusSpec, DataFrame]], tokenizer: Tokenizer = WORDS
) -> dict[str, DataFrame]:
    """Named report tables over whole corpora.

    Finding the sample rows runs small jobs over the id columns; the rest runs when read.
    """
    specs = tuple(spec for spec, _ in corpora.values())
    spark = next(iter(corpora.values()))[1].sparkSession
    frames = {
        name: eda_frame(df, spec.text_column, spec.label_column, spec.language)
        for name, (spec, df) in corpora.items()
    }
    stacked = stack_corpora(frames).withColumn("primary_len", primary_length())
    summary = summarize_corpora(stacked, ["corpus", "language"])
    report = {
        "summary": summary_rows(summary, registry_frame(spark, specs)),
        "label_distribution": label_distribution(stacked, "label", ["corpus"]),
        "length_histogram": length_histogram(stacked, ["corpus"], "primary_len"),
        "char_boxplot": boxplot_stats(stacked, ["corpus"], "char_len"),
        "word_boxplot": boxplot_stats(stacked, ["corpus"], "word_len"),
        "flags": quality_flags(summary, "corpus"),
    }
    for name, (spec, df) in corpora.items():
        report[f"tokens_{name}"] = token_length_stats(
            df, spec.text_column, spec.id_column, tokenizer
        )
        report[f"sample_{name}"] = sample_rows(
            df, spec.text_column, spec.label_column, spec.id_column
        )
    return report
