"""Toxicity of texts: boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are dealt in the order of a hash of their id, class by class, to three parts:
one yields the lexicon, one the trees, one the calibration, so that neither later step sees
rows that the former has learned by heart. A text's features are computed in one pass over it and don't depend
on any other column.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_AT_A_TIME, arrow_map, cut_lineage, plus, share, table

#: Bound on the labelled rows that a model is fitted on.
FIT_ROWS = 20_000
#: Bound on the learned lexicon.
LEXICON_UNITS = 5_000
#: Lexicon units: whole words, and their starts of these lengths (for inflected words).
STARTS = (4, 5, 6, 7)
#: A unit is in at least this share of the part's toxic texts, and in two of them.
MIN_TOXIC_SHARE = 0.03
MIN_LOG_ODDS = 1.5
PROXIMITY_WORDS = 5
#: Units that a task counts before it hands the counts on.
COUNTED_UNITS = 100_000
REMEMBERED_WORDS = 100_000
#: Parts that every eight rows of a class go to; the first two rows give a model already.
PARTS = ("trees", "calibration", "lexicon", "trees", "lexicon", "trees", "lexicon", "lexicon")
#: Share of the trees' probability in a score; the rest is the calibrated value.
OWN_SHARE = 0.02

FEATURES = (
    "hit_density weight_density top_weight top_weights distinct_weights hits distinct_hits near_second_person "
    "second_person_density capitals shouted exclamations punctuation obfuscated "
    "obfuscated_hits stretched words"
).split()

#: Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur "
    "du dich dir dein deine deinen ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro vuestra".split()
)

_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[a-z]+(?:[@$!|*0134578._-]+[a-z]+)+")
_SPACED = re.compile(r"(?<![a-z])(?:[a-z] ){3,}[a-z](?![a-z])")
_STRETCHED = re.compile(r"([a-z])\1{3,}")
_PLAIN = str.maketrans("@$!|0134578", "asiloleastb")
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def _units(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STARTS if len(word) >= n)]


class Weights(dict):
    """word -> weight of its best lexicon unit, remembered for words seen before."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __reduce__(self):
        return Weights, (self.lexicon,)

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        weight = max((self.lexicon.get(u, 0.0) for u in _units(word)), default=0.0)
        if len(word) <= 64:
            self[word] = weight
        return weight


def text_features(text: str, weights: Weights) -> list[float]:
    """The values of FEATURES; all zero for an empty text."""
    low = text.lower()
    words = _WORD.findall(low)
    data = text.encode()
    size = max(len(data), 1)
    n = max(len(words), 1)
    weight = [weights[w] for w in words]
    hits = [i for i, x in enumerate(weight) if x > 0.0]
    second = {i for i, w in enumerate(words) if w in SECOND_PERSON}
    distinct = sorted({words[i]: weight[i] for i in hits}.values(), reverse=True)
    near = sum(
        any(j in second for j in range(i - PROXIMITY_WORDS, i + PROXIMITY_WORDS + 1))
        for i in (hits if second else ())
    )
    upper = len(data) - len(data.translate(None, _UPPER))
    lower = len(data) - len(data.translate(None, _LOWER))
    mixed = _MIXED.findall(low)
    plain = [re.sub(r"[^a-z]", "", m.translate(_PLAIN)) for m in mixed]
    spaced = [m.replace(" ", "") for m in _SPACED.findall(low)]
    return [
        len(hits) / n,
        sum(weight[i] for i in hits) / n,
        max((weight[i] for i in hits), default=0.0),
        sum(distinct[:4]),
        math.log1p(sum(distinct)),
        math.log1p(len(hits)),
        math.log1p(len(distinct)),
        math.log1p(near),
        len(second) / n,
        upper / max(upper + lower, 1),
        1.0 if upper > 3 * lower else 0.0,
        data.count(b"!") / size,
        (len(data) - len(data.translate(None, _SIGNS))) / size,
        (len(mixed) + len(spaced)) / n,
        math.log1p(sum(weights[w] > 0.0 for w in [*plain, *spaced])),
        sum(1 for _ in _STRETCHED.finditer(low)) / n,
        math.log1p(len(words)),
    ]


def with_features(df: DataFrame, text_column: str, lexicon: dict[str, float], output: str) -> DataFrame:
    """``df`` with an array column of the features; null texts count as empty."""
    shared = share(df.sparkSession, Weights(lexicon))
    kept = [c for c in df.columns if c != output]
    schema = plus(df.select(*(F.col(f"`{c}`") for c in kept)).schema, f"`{output}` array<double>")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = batch.schema.get_field_index
        texts = batch.column(index(text_column)).to_pylist()
        made = pa.array([text_features(t or "", shared()) for t in texts], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*(batch.column(index(c)) for c in kept), made], [*kept, output])

    return arrow_map(df, schema, rows)


def learn_lexicon(texts: DataFrame, rows: int = LEXICON_UNITS) -> dict[str, float]:
    """Units whose share among toxic texts is far above that among others, with log odds.

    ``texts`` has text and toxic; equal texts count once. Counts are summed inside of each
    task before the shuffle; at most ``rows`` units come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME).to_pydict()
                for text, toxic in zip(part["text"], part["toxic"], strict=True):
                    words = set(_WORD.findall(text.lower()))
                    counts[toxic].update({u for w in words for u in _units(w)})
                    if len(counts[0]) + len(counts[1]) > COUNTED_UNITS:
                        yield handed_on(counts)
        yield handed_on(counts)

    def handed_on(counts: dict[int, Counter]) -> pa.RecordBatch:
        names = list({*counts[0], *counts[1]})
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([counts[y][u] for u in names], pa.int64()) for y in (1, 0))],
            ["unit", "toxic", "other"],
        )
        for y in counts:
            counts[y] = Counter()
        return out

    distinct = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = (F.lit(total.get(y, 0) + 1.0) for y in (1, 0))
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("other") + 0.5) / other)
    found = (
        distinct.mapInArrow(count, "unit string, toxic long, other long")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") >= max(2, math.ceil(MIN_TOXIC_SHARE * total.get(1, 0))))
        .select("unit", "toxic", odds.alias("odds"))
        .where(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy(F.desc(F.col("odds") * F.log("toxic")), "unit")
        .limit(rows)
    )
    return {r["unit"]: r["odds"] for r in found.collect()}


@dataclass
class ToxicityModel:
    """Fitted lexicon, trees and calibration; without the last two the score is constant."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
        """Fit on at most ``rows`` labelled documents, chosen by a hash of their id.

        docs: doc_id, text. labels: doc_id, toxic (0/1; null: not labelled). Of repeated
        labels of a document the largest counts. With fewer than two documents of a class no
        model can be fitted: the score is the share of toxic rows, 0 without any label.
        """
        spark = docs.sparkSession
        chosen = (
            labels.where("toxic in (0, 1) and doc_id is not null")
            .groupBy("doc_id")
            .agg(F.max("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(rows)
        )
        # At most ``rows`` rows of two numbers.
        sample = cut_lineage(
            docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
        )
        rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit("part"), "doc_id"), "doc_id"))
        turns = F.array(*map(F.lit, PARTS))
        dealt = sample.select("doc_id", "toxic").distinct().select(
            "doc_id", F.get(turns, F.pmod(rank - 1, F.lit(len(PARTS)))).alias("part")
        )
        sample = cut_lineage(sample.join(F.broadcast(dealt), "doc_id").select("text", "toxic", "part"))
        counts = {(r["part"], r["toxic"]): r["n"] for r in sample.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        share = sum(n for (_, y), n in counts.items() if y) / total if total else 0.0
        if not all(counts.get((f, y)) for f in ("trees", "calibration") for y in (0, 1)):
            return cls({}, None, None, share)
        lexicon = learn_lexicon(sample.where("part = 'lexicon'"))
        dense = cut_lineage(
            with_features(sample.where("part <> 'lexicon'"), "text", lexicon, "features").select(
                "part", "toxic", "features"
            ).coalesce(max(1, spark.sparkContext.defaultParallelism // 2))
        )
        rows_ = dense.select("part", "toxic", array_to_vector("features").alias("features"))
        trees = GBTClassifier(
            labelCol="toxic", featuresCol="features", maxIter=30, maxDepth=3, maxBins=32,
            stepSize=0.3, minInstancesPerNode=5, seed=7,
        ).fit(rows_.where("part = 'trees'"))
        margins = trees.transform(rows_.where("part = 'calibration'")).select(
            F.col("toxic").cast("double").alias("toxic"), _margin().alias("margin")
        )
        calibration = IsotonicRegression(labelCol="toxic", featuresCol="margin").fit(margins)
        return cls(lexicon, trees, calibration, share)

    def score(self, df: DataFrame, text_column: str = "text", output: str = "score") -> DataFrame:
        """``df`` with a double column from 0 to 1; null texts score as empty ones."""
        if self.trees is None:
            return df.withColumn(output, F.lit(float(self.share)))
        kept = [c for c in df.columns if c != output]
        # Inner names can't clash with the frame's own: its columns travel in one struct.
        packed = df.select(
            F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text_column}`").alias("text")
        )
        dense = with_features(packed, "text", self.lexicon, "features").select(
            "row", array_to_vector("features").alias("features")
        )
        margins = self.trees.transform(dense).select("row", _margin().alias("margin"))
        scored = self.calibration.transform(margins)
        # Calibrated values are steps: a small share of the trees' own value orders what ties.
        blend = (1 - OWN_SHARE) * F.col("prediction") + OWN_SHARE / (1 + F.exp(-2 * F.col("margin")))
        bounded = F.least(F.greatest(blend, F.lit(0.0)), F.lit(1.0))
        return scored.select(*(F.col("row")[c].alias(c) for c in kept), bounded.alias(output))


def _margin():
    return vector_to_array(F.col("rawPrediction"))[1]


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3


def fit_without_held_out(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1 alone."""
    return ToxicityModel.fit(docs, labels.where(remainder() != 1))


def toxicity_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Repeated rows give repeated rows;
    a null doc_id is not held out."""
    scored = fit_without_held_out(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select(
        "doc_id",
        F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, all columns as they are; all documents
    if the labels don't suffice for a model."""
    model = fit_without_held_out(docs, labels)
    if model.trees is None:
        return docs
    names = docs.columns
    score = "score"
    while score in names:
        score += "_"
    scored = model.score(docs, "text", score)
    return scored.where(F.col(f"`{score}`") < threshold).select(*(F.col(f"`{c}`") for c in names))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
