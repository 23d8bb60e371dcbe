"""Corpus profiling: feature projection, label balance, summaries, quality flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiweave.functions.numeric import ratio, round_to
from sentiweave.functions.text import (
    MAX_SEQUENCE_LENGTH,
    WORDS,
    Tokenizer,
    char_count,
    fingerprint,
    is_blank,
    token_count,
    word_count,
)
from sentiweave.operators.histogram import (
    floor_quantile,
    value_counts,
    with_running_counts,
)
from sentiweave.operators.sampling import first_n
from sentiweave.schema import require_columns

# Thresholds of the quality rules.
MAX_LABEL_SKEW = 0.1
MAX_DUPLICATE_RATE = 0.05
MAX_PCT_OVER_LENGTH = 5.0


def label_text(label: Column) -> Column:
    """Labels as strings, so that corpora with different encodings stack; null is ``None``.

    Booleans are ``True`` and ``False``.
    """
    text = label.cast("string")
    boolean = F.typeof(label) == "boolean"
    return F.coalesce(F.when(boolean, F.initcap(text)).otherwise(text), F.lit("None"))


def eda_frame(
    df: DataFrame, text_column: str, label_column: str, language: str | Column
) -> DataFrame:
    """``text, label, char_len, word_len, language`` of any labelled corpus."""
    require_columns(df, [text_column, label_column])
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return df.select(
        text.alias("text"),
        label_text(F.col(label_column)).alias("label"),
        char_count(text).alias("char_len"),
        word_count(text).alias("word_len"),
        (F.lit(language) if isinstance(language, str) else language).alias("language"),
    )


def stack_corpora(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of EDA frames with a ``corpus`` column."""
    tagged = [df.withColumn("corpus", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)


def label_distribution(
    df: DataFrame, label_column: str = "label", by: list[str] | None = None
) -> DataFrame:
    """Count, ratio and percentage per label, most frequent first (in each group).

    The total is a window over the label counts, not over rows.
    """
    by = by or []
    total = F.sum("count").over(Window.partitionBy(*by))
    return (
        df.groupBy(*by, label_column)
        .agg(F.count("*").alias("count"))
        .withColumn("_total", total)
        .withColumn("ratio", round_to(ratio(F.col("count"), F.col("_total")), 4))
        .withColumn("pct", round_to(F.col("count") / F.col("_total") * 100, 1))
        .drop("_total")
        .orderBy(*by, F.desc("count"), label_column)
    )


def _share_of(hit: Column, n: Column) -> Column:
    return round_to(ratio(F.sum(F.when(hit, n).otherwise(0)), F.sum(n)), 4)


def positive_ratio_agg(
    label: Column, kind: T.DataType, n: Column, rows: Column | None = None
) -> Column:
    """Aggregate over label counts: share of the positive class for known encodings.

    Strings: {0,1}, {negative,positive} and {neg,pos} in any case. Numbers and
    booleans: {0,1}, else the larger of exactly two values. Anything else is null.
    ``rows`` marks the label rows of a table that also holds others.
    """
    rows = F.lit(True) if rows is None else rows
    n = F.when(rows, n)

    def only(values: Column, *allowed: object) -> Column:
        return F.every(F.when(rows, F.coalesce(values.isin(*allowed), F.lit(False))))

    if isinstance(kind, T.StringType):
        word = F.lower(label)
        return (
            F.when(only(label, "0", "1"), _share_of(label == "1", n))
            .when(only(word, "negative", "positive"), _share_of(word == "positive", n))
            .when(only(word, "neg", "pos"), _share_of(word == "pos", n))
        )
    number = label.cast("double")
    whole = F.every(label.isNotNull())
    top = round_to(ratio(F.max_by(n, number), F.sum(n)), 4)
    return F.when(only(number, 0.0, 1.0), _share_of(number == 1.0, n)).when(
        whole & (F.count(number) == 2), top
    )


def positive_ratio(df: DataFrame, label_column: str, by: list[str] | None = None) -> DataFrame:
    """``positive_ratio`` per group."""
    by = by or []
    kind = df.schema[label_column].dataType
    counts = value_counts(df, by, label_column)
    return counts.groupBy(*by).agg(
        positive_ratio_agg(F.col("value"), kind, F.col("n")).alias("positive_ratio")
    )


def label_counts_agg(label: Column, n: Column, keep: Column | None = None) -> Column:
    """Aggregate over label counts: map label → count in label order."""
    pair = F.struct(label.alias("label"), n.alias("n"))
    pairs = F.array_sort(F.collect_list(pair if keep is None else F.when(keep, pair)))
    return F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(label_text(p["label"]), p["n"]))
    )


def label_counts_text(counts: Column, quote: bool = True) -> Column:
    """Printed form of a label-count map: ``{'0': 3, '1': 5}``."""
    mark = "'" if quote else ""
    parts = F.transform(
        F.map_entries(counts),
        lambda e: F.concat(F.lit(mark), e["key"], F.lit(f"{mark}: "), e["value"].cast("string")),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


_CHARS, _WORDS, _LABEL, _COPY = 0, 1, 2, 3


def summary_counts(eda: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a summary is made of: ``(by, facet, value, name, n)``, from one scan.

    Each row becomes four facets (character length, word length, label, text
    fingerprint) which are counted together with map-side combine. Counts of parts of a
    corpus add up to those of the whole; see :func:`merged_counts`.
    """
    by = by or ["language"]
    number, word = T.LongType(), T.StringType()

    def facet(code: int, value: Column | None, name: Column | None) -> Column:
        return F.struct(
            F.lit(code).alias("facet"),
            (F.lit(None) if value is None else value).cast(number).alias("value"),
            (F.lit(None) if name is None else name).cast(word).alias("name"),
        )

    text = F.col("text")
    facets = F.array(
        facet(_CHARS, F.col("char_len"), None),
        facet(_WORDS, F.col("word_len"), None),
        facet(_LABEL, None, F.col("label")),
        facet(_COPY, None, F.when(~is_blank(text), fingerprint(text))),
    )
    return eda.select(*by, F.inline(facets)).groupBy(*by, "facet", "value", "name").agg(F.count("*").alias("n"))


def merged_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of several parts (stacked) as those of the whole."""
    by = by or ["language"]
    return counts.groupBy(*by, "facet", "value", "name").agg(F.sum("n").alias("n"))


def summarize_corpora(
    eda: DataFrame, by: list[str] | None = None, char_threshold: int = MAX_SEQUENCE_LENGTH
) -> DataFrame:
    """The 21 summary fields per group of an EDA frame, from one scan. ``by`` must include ``language``."""
    return summary_of_counts(summary_counts(eda, by), by, char_threshold)


def summary_of_counts(
    counted: DataFrame, by: list[str] | None = None, char_threshold: int = MAX_SEQUENCE_LENGTH
) -> DataFrame:
    """The summary fields per group, from counts.

    Fingerprints are folded to two numbers per group, so that everything after the first
    shuffle works on histograms.
    """
    by = by or ["language"]
    copies = F.col("facet") == _COPY
    folded = (
        counted.withColumn("blank", F.when(copies & F.col("name").isNull(), F.col("n")))
        .withColumn(
            "extra", F.when(copies & F.col("name").isNotNull(), F.col("n") - 1)
        )
        .withColumn("name", F.when(~copies, F.col("name")))
        .groupBy(*by, "facet", "value", "name")
        .agg(*(F.sum(c).alias(c) for c in ("n", "blank", "extra")))
    )
    running = with_running_counts(folded, [*by, "facet"])

    def when_facet(code: int, column: Column) -> Column:
        return F.when(F.col("facet") == code, column)

    def length_fields(prefix: str, code: int) -> dict[str, Column]:
        def quantile(q: float) -> Column:
            spot = F.floor(F.lit(q) * (F.col("total") - 1))
            return F.min(when_facet(code, F.when(F.col("upto") > spot, F.col("value"))))

        weighted = F.sum(when_facet(code, F.col("value") * F.col("n")))
        rows = F.sum(when_facet(code, F.col("n")))
        return {
            f"{prefix}_mean": round_to(ratio(weighted, rows), 1),
            **{f"{prefix}_p{int(q * 100)}": quantile(q).cast("double") for q in (0.5, 0.9, 0.95)},
        }

    label_rows = F.sum(when_facet(_LABEL, F.col("n")))
    label, is_label = when_facet(_LABEL, F.col("name")), F.col("facet") == _LABEL
    kept = running.groupBy(*by).agg(
        label_rows.alias("n_rows"),
        F.count(label).alias("n_unique_labels"),
        label_counts_agg(F.col("name"), F.col("n"), is_label).alias("label_counts"),
        positive_ratio_agg(label, T.StringType(), F.col("n"), is_label).alias("positive_ratio"),
        *(c.alias(a) for a, c in length_fields("char_len", _CHARS).items()),
        F.max(when_facet(_CHARS, F.col("value"))).alias("char_len_max"),
        *(c.alias(a) for a, c in length_fields("word_len", _WORDS).items()),
        F.sum(
            when_facet(_CHARS, F.when(F.col("value") > char_threshold, F.col("n")).otherwise(0))
        ).alias("_over"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("empty_texts"),
        F.coalesce(F.sum("extra"), F.lit(0)).alias("_extra"),
    )
    zh = F.col("language") == "zh"
    texts = F.col("n_rows") - F.col("empty_texts")
    fields = {
        "label_skew": round_to(F.abs(F.col("positive_ratio") - 0.5), 4),
        "primary_length_metric": F.when(zh, "char_len").otherwise("word_len"),
        "primary_len_p95": F.when(zh, F.col("char_len_p95")).otherwise(F.col("word_len_p95")),
        "pct_over_char_threshold": round_to(ratio(F.col("_over"), F.col("n_rows")) * 100, 2),
        "duplicate_rate": F.coalesce(round_to(ratio(F.col("_extra"), texts), 4), F.lit(0.0)),
        "is_binary": F.col("n_unique_labels") == 2,
    }
    order = [
        *by, "n_rows", "n_unique_labels", "label_counts", "positive_ratio", "label_skew",
        "char_len_mean", "char_len_p50", "char_len_p90", "char_len_p95", "char_len_max",
        "word_len_mean", "word_len_p50", "word_len_p90", "word_len_p95",
        "primary_length_metric", "primary_len_p95", "pct_over_char_threshold",
        "empty_texts", "duplicate_rate", "is_binary",
    ]
    return kept.withColumns(fields).select(*order)


def summary_rows(summary: DataFrame, registry: DataFrame) -> DataFrame:
    """Display rows: summary fields plus registry metadata, in role, language, name order.

    ``summary`` is grouped by ``corpus`` and ``language``. Corpora that the registry doesn't
    have stay, without its fields.
    """
    meta = registry.select(
        F.col("name"), F.col("role"), F.col("language"), F.col("dataset_id")
    )
    return (
        summary.withColumnRenamed("corpus", "name")
        .join(meta, ["name", "language"], "left")
        .select(
            "name",
            "role",
            "language",
            "dataset_id",
            "n_rows",
            "is_binary",
            "positive_ratio",
            "label_skew",
            "char_len_p95",
            "word_len_p95",
            F.col("pct_over_char_threshold").alias("pct_over_char_256"),
            "duplicate_rate",
            "empty_texts",
            label_counts_text(F.col("label_counts")).alias("label_counts"),
        )
        .orderBy("role", "language", "name")
    )


def corpus_profile(
    df: DataFrame, text_column: str, label_column: str, by: list[str] | None = None
) -> DataFrame:
    """Row count, columns, label counts and length statistics per group, in one scan."""
    require_columns(df, [text_column, label_column])
    by = by or []
    text = F.col(text_column)
    chars, words = F.coalesce(char_count(text), F.lit(0)), F.coalesce(word_count(text), F.lit(0))
    per_label = (
        df.select(
            *by,
            F.col(label_column).alias("label"),
            chars.alias("chars"),
            words.alias("words"),
            is_blank(text).cast("long").alias("blank"),
        )
        .groupBy(*by, "label")
        .agg(
            F.count("*").alias("n"),
            F.min("chars").alias("low"),
            F.max("chars").alias("high"),
            F.sum("chars").alias("chars"),
            F.sum("words").alias("words"),
            F.sum("blank").alias("blank"),
        )
    )
    rows = F.sum("n")
    zero, none = F.lit(0), F.lit(0.0)
    return per_label.groupBy(*by).agg(
        F.coalesce(rows, zero).alias("n_rows"),
        F.lit(", ".join(df.columns)).alias("columns"),
        label_counts_agg(F.col("label"), F.col("n")).alias("label_counts"),
        F.count("*").alias("n_unique_labels"),
        F.coalesce(F.min("low"), zero).alias("char_len_min"),
        F.coalesce(F.max("high"), zero).alias("char_len_max"),
        F.coalesce(round_to(ratio(F.sum("chars"), rows), 1), none).alias("char_len_mean"),
        F.coalesce(round_to(ratio(F.sum("words"), rows), 1), none).alias("word_len_mean"),
        F.coalesce(F.sum("blank"), zero).alias("empty_texts"),
    )


def profiles_frame(profiles: dict[str, DataFrame]) -> DataFrame:
    """One-row profiles stacked to a table with a ``name`` column."""
    named = [df.select(F.lit(name).alias("name"), "*") for name, df in profiles.items()]
    return reduce(DataFrame.unionByName, named)


def token_length_stats(
    df: DataFrame,
    text_column: str,
    id_column: str,
    tokenizer: Tokenizer = WORDS,
    max_samples: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Token-length statistics of all rows, or of the first ``max_samples`` of each group."""
    by = by or []
    rows = df.select(*by, text_column, id_column)
    if max_samples is not None:
        rows = first_n(rows, max_samples, id_column, strata=by)
    counts = value_counts(rows, by, token_count(F.col(text_column), tokenizer))
    running = with_running_counts(counts, by)
    size = F.sum("n")
    over = F.sum(F.when(F.col("value") > MAX_SEQUENCE_LENGTH, F.col("n")).otherwise(0))
    return running.groupBy(*by).agg(
        size.alias("token_sample_size"),
        round_to(ratio(F.sum(F.col("value") * F.col("n")), size), 1).alias("token_len_mean"),
        floor_quantile(0.5).cast("double").alias("token_len_p50"),
        floor_quantile(0.95).cast("double").alias("token_len_p95"),
        F.max("value").alias("token_len_max"),
        round_to(ratio(over, size) * 100, 2).alias("pct_over_max_tokens"),
    )


def quality_flags(summary: DataFrame, name: str = "name") -> DataFrame:
    """One row per broken quality rule of a summary table: ``name, rule, measured``."""

    def rule(code: str, broken: Column, measured: Column) -> Column:
        hit = F.struct(F.lit(code).alias("rule"), measured.cast("double").alias("measured"))
        return F.when(broken, hit)

    rules = [
        rule("not_binary", ~F.col("is_binary"), F.col("n_unique_labels")),
        rule("label_skew", F.col("label_skew") > MAX_LABEL_SKEW, F.col("label_skew")),
        rule(
            "duplicates", F.col("duplicate_rate") > MAX_DUPLICATE_RATE, F.col("duplicate_rate")
        ),
        rule("empty_texts", F.col("empty_texts") > 0, F.col("empty_texts")),
        rule(
            "long_texts",
            F.col("pct_over_char_threshold") > MAX_PCT_OVER_LENGTH,
            F.col("pct_over_char_threshold"),
        ),
        rule(
            "labels_need_mapping",
            F.exists(F.map_keys("label_counts"), lambda key: ~key.isin("0", "1")),
            F.col("n_unique_labels"),
        ),
    ]
    return summary.select(F.col(name), F.inline(F.array_compact(F.array(*rules))))
