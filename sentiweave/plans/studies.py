"""The declared studies: aspects, native against translated, calibration, tokenization."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiweave.functions.numeric import ratio
from sentiweave.functions.text import WORDS, Tokenizer
from sentiweave.operators.metrics import binary_metrics
from sentiweave.schema import require_columns


#: Scripts without spaces between words: Han, kana, Thai.
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\U00020000-\U0002ffff]")
#: Tables of first choices up to so many rows travel to every task.
_BROADCAST_ROWS = 10_000


def tag_aspects(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Array of the aspects with a keyword in the lower-cased text.

    A keyword is one of the text's words; keywords of scripts that are written without
    spaces count wherever they stand.
    """
    low = F.lower(text)
    words = F.split(low, r"[^\p{L}\p{N}]+")
    tags = []
    for aspect, terms in keywords.items():
        inside = [t for t in terms if _UNSPACED.search(t)]
        spaced = [t for t in terms if t not in inside]
        hit = F.arrays_overlap(words, F.array(*map(F.lit, spaced))) if spaced else F.lit(False)
        for term in inside:
            hit = hit | F.contains(low, F.lit(term.lower()))
        tags.append(F.when(hit, F.lit(aspect)))
    return F.array_compact(F.array(*tags))


def aspect_sentiment(
    df: DataFrame, aspects: list[str], by_topic: bool = False
) -> DataFrame:
    """Mean sentiment score per aspect and language (and topic) of aspect-tagged posts."""
    keys = ["aspect", "lang", *(["topic"] if by_topic else [])]
    require_columns(df, ["aspects", "sentiment_score", *keys[1:]])
    tagged = df.select(
        *keys[1:], "sentiment_score", F.explode(F.array_distinct("aspects")).alias("aspect")
    ).where(F.col("aspect").isin(*aspects))
    return tagged.groupBy(*keys).agg(
        F.avg("sentiment_score").alias("mean_score"), F.count("*").alias("n_posts")
    )


def translation_gap(
    native: DataFrame, translated: DataFrame, key: str = "post_id", by: str = "lang"
) -> DataFrame:
    """Mean of native minus translated sentiment per language, over posts scored both ways.

    ``key`` is unique on both sides, so neither side of the join has a hot key.
    """
    other = translated.select(key, F.col("sentiment_score").alias("_translated"))
    return (
        native.select(key, by, "sentiment_score")
        .join(other, key)
        .groupBy(by)
        .agg(
            F.avg("sentiment_score").alias("native_score"),
            F.avg("_translated").alias("translated_score"),
            F.avg(F.col("sentiment_score") - F.col("_translated")).alias("gap"),
            F.count("*").alias("n_posts"),
        )
    )


def gold_accuracy(
    predictions: DataFrame, gold: DataFrame, slices: list[str], key: str = "post_id"
) -> DataFrame:
    """Metrics of predictions against gold labels per slice."""
    guess = predictions.select(key, F.col("sentiment_label").alias("_guess"))
    joined = gold.select(key, "label", *slices).join(guess, key)
    return binary_metrics(joined, "label", "_guess", slices)


def temperature_grid(low: float = 0.05, high: float = 10.0, steps: int = 60) -> list[float]:
    """Temperatures at equal ratios between ``low`` and ``high``."""
    return [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]


def nll_by_temperature(
    df: DataFrame, logits: str, label: str, by: list[str], grid: list[float] | Column
) -> DataFrame:
    """Mean negative log-likelihood of ``softmax(logits / T)`` for each T of the grid.

    One pass; rows meet the grid inside the task and only sums are shuffled.
    """
    steps = grid if isinstance(grid, Column) else F.array(*map(F.lit, grid))
    rows = df.select(
        *by,
        F.transform(logits, lambda x: x.cast("double")).alias("_z"),
        F.col(label).cast("int").alias("_y"),
        steps.alias("_grid"),
    ).withColumn("_top", F.array_max("_z"))
    spread = rows.select(*by, "_z", "_y", "_top", F.explode("_grid").alias("temperature"))
    # log-sum-exp, shifted by the largest logit.
    mass = F.aggregate(
        "_z",
        F.lit(0.0),
        lambda total, x: total + F.exp((x - F.col("_top")) / F.col("temperature")),
    )
    loss = F.log(mass) - (F.get("_z", F.col("_y")) - F.col("_top")) / F.col("temperature")
    return spread.groupBy(*by, "temperature").agg(
        F.avg(loss).alias("nll"), F.count("*").alias("n_rows")
    )


def _best_temperature(losses: DataFrame, by: list[str]) -> DataFrame:
    best = F.min_by("temperature", F.struct("nll", "temperature"))
    return losses.groupBy(*by).agg(best.alias("temperature"), F.min("nll").alias("nll"))


def fit_temperature(
    df: DataFrame,
    logits: str,
    label: str,
    by: list[str],
    grid: list[float] | None = None,
    refine: bool = True,
) -> DataFrame:
    """Temperature with the lowest loss per group (such as the language).

    With ``refine`` a second pass tries 21 temperatures between the neighbours of the
    group's first choice. The table of first choices has one row per group.
    """
    grid = sorted(grid or temperature_grid())
    best = _best_temperature(nll_by_temperature(df, logits, label, by, grid), by)
    if not refine or len(grid) < 2:
        return best
    step = max(b / a for a, b in zip(grid, grid[1:]))
    near = F.transform(
        F.sequence(F.lit(-10), F.lit(10)), lambda i: F.col("_first") * F.pow(F.lit(step), i / 10)
    )
    first = best.select(*by, F.col("temperature").alias("_first"))
    # Few groups with many rows each: their small table is read once and goes to the rows.
    found = first.limit(_BROADCAST_ROWS + 1).collect()
    if len(found) <= _BROADCAST_ROWS:
        first = F.broadcast(df.sparkSession.createDataFrame(found, first.schema))
    rows = df.select(*by, logits, label).join(first, by)
    return _best_temperature(nll_by_temperature(rows, logits, label, by, near), by)


def token_fragmentation(
    df: DataFrame,
    text: str,
    by: list[str],
    subwords: Tokenizer,
    words: Tokenizer = WORDS,
) -> DataFrame:
    """How far a subword tokenizer cuts words apart, per group.

    Words are counted first, so the subword tokenizer runs once per distinct word
    and group, not once per occurrence.
    """
    vocabulary = (
        df.select(*by, F.explode(words.split(F.col(text))).alias("word"))
        .groupBy(*by, "word")
        .agg(F.count("*").alias("n"))
        .withColumn("pieces", F.size(subwords.split(F.col("word"))))
    )
    total = F.sum("n")
    split = F.sum(F.when(F.col("pieces") > 1, F.col("n")).otherwise(0))
    return vocabulary.groupBy(*by).agg(
        total.alias("n_words"),
        F.sum(F.col("n") * F.col("pieces")).alias("n_subwords"),
        ratio(F.sum(F.col("n") * F.col("pieces")), total).alias("subwords_per_word"),
        ratio(split, total).alias("fragmentation_rate"),
        F.max("pieces").alias("max_subwords"),
    )


_ENDS = T.StructType(
    [T.StructField("words", T.LongType()), T.StructField("hits", T.LongType())]
)


#: Tokens whose ends are compared at once.
_TOKENS = 1 << 18


@F.arrow_udf(_ENDS)
def _word_ends_hit(words: pa.Array, subwords: pa.Array) -> pa.Array:
    """Word ends of each text, and how many of them are subword ends, from token lengths.

    The ends of some texts are compared at once: each text's start at a place of its own.
    """
    tokens = np.cumsum(_sizes(words) + _sizes(subwords))
    hits, at = [], 0
    while at < len(tokens):
        # As many texts as have ``_TOKENS`` tokens, one at least.
        to = max(at + 1, int(np.searchsorted(tokens, (tokens[at - 1] if at else 0) + _TOKENS, "right")))
        hits.append(_hits(words.slice(at, to - at), subwords.slice(at, to - at)))
        at = to
    found = np.concatenate(hits) if hits else np.empty(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(_sizes(words)), pa.array(found)], ["words", "hits"])


def _hits(words: pa.Array, subwords: pa.Array) -> np.ndarray:
    ends, sizes = zip(*(_batch_ends(tokens) for tokens in (words, subwords)))
    span = max((int(e.max()) for e in ends if len(e)), default=0) + 1
    own, other = (e + span * np.repeat(np.arange(len(n)), n) for e, n in zip(ends, sizes))
    hit = np.concatenate(([0], np.cumsum(np.isin(own, other))))
    edges = np.concatenate(([0], np.cumsum(sizes[0])))
    return hit[edges[1:]] - hit[edges[:-1]]


def _sizes(tokens: pa.Array) -> np.ndarray:
    return tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _batch_ends(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all tokens, counted from their text's start, and the number of each text's."""
    sizes = _sizes(tokens)
    total = np.cumsum(tokens.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0) if len(total) else starts * 0
    return total - np.repeat(before, sizes), sizes


def _lengths(tokens: Column) -> Column:
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), F.length)


def boundary_agreement(
    df: DataFrame,
    text: str,
    by: list[str],
    subwords: Tokenizer,
    words: Tokenizer = WORDS,
) -> DataFrame:
    """Share of word ends that are also subword ends, per group.

    Both tokenizers must cover the same characters (spaces apart). Ends are compared
    text by text inside the task, so that no token is shuffled.
    """
    lengths = (_lengths(tokenizer.split(F.col(text))) for tokenizer in (words, subwords))
    hit = _word_ends_hit(*lengths)
    ends = df.select(*by, hit.alias("_ends")).select(*by, "_ends.*")
    return ends.groupBy(*by).agg(
        F.sum("words").alias("n_word_ends"),
        F.sum("hits").alias("n_shared_ends"),
        ratio(F.sum("hits"), F.sum("words")).alias("boundary_agreement"),
    )
