"""A sentiment classifier on averaged word embeddings, trained by mini-batches on the cluster.

Words are hashed to rows of an embedding table; a text is the mean of its words' rows, and one
layer above gives its log odds. Training rows are dealt to batches and parts of batches by a
hash of their id and written once, a folder a batch, ids packed as bytes. A step reads its
batch; a word moves log odds by one number, its row times the layer above, so tasks look up
one number a word and add up one slope an embedding row, of which the driver makes the
gradients. It holds the parameters (of a fixed size, whatever the corpus) and moves them at a
rate that warms up and then falls to zero. Layers can be frozen. Sums are taken part by part,
whatever tasks parts are read by, so equal seeds and data give equal models (parts of files
that Spark splits in two or more are equal up to the last digits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiweave.functions.text import words
from sentiweave.plans.scoring import Scorer
from sentiweave.session import scratch_path
from sentiweave.sources.registry import SEED

#: Parts of a batch and tasks of a step; bounds what reaches the driver in one.
STEP_TASKS = 16
#: Bytes of packed ids that a task adds up at once.
_CHUNK = 1 << 22


@dataclass(frozen=True)
class EmbeddingOptions:
    """Settings of a fit. ``frozen`` names layers that stay as they begin: embedding, output, bias."""

    buckets: int = 1 << 12
    size: int = 16
    epochs: int = 6
    batches: int = 8
    rate: float = 2.0
    warmup: float = 0.1
    weight_decay: float = 1e-4
    frozen: tuple[str, ...] = ()
    seed: int = SEED


@dataclass
class EmbeddingModel:
    """Layers by name, and the mean loss of each step."""

    layers: dict[str, np.ndarray]
    losses: list[float] = field(default_factory=list)

    @property
    def buckets(self) -> int:
        return len(self.layers["embedding"])


def bucket_ids(text: Column, buckets: int) -> Column:
    """Embedding rows of a text's words, in lower case; a null text has none."""
    found = words(F.lower(F.coalesce(text, F.lit(""))))
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def first_layers(options: EmbeddingOptions) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(options.seed)
    return {
        "embedding": rng.normal(scale=1 / options.size, size=(options.buckets, options.size)),
        "output": rng.normal(scale=1 / np.sqrt(options.size), size=options.size),
        "bias": np.zeros(1),
    }


def rate_at(step: int, steps: int, options: EmbeddingOptions) -> float:
    """Rises to ``rate`` over the share ``warmup`` of the steps, then falls in a line to zero."""
    warm = max(1, round(options.warmup * steps))
    return options.rate * min((step + 1) / warm, (steps - step) / max(1, steps - warm + 1))


def word_odds(layers: dict[str, np.ndarray]) -> np.ndarray:
    """What a word of each embedding row adds to the log odds of a text that is this word alone."""
    return layers["embedding"] @ layers["output"]


def odds(weights: np.ndarray, bias: float, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log odds of each text: the mean of its words' :func:`word_odds`, zero without words, and the bias."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(owner, weights[ids], len(sizes)) / np.maximum(sizes, 1) + bias


def _chances(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def slopes(weights: np.ndarray, bias: float, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows: the loss's slope by each row of :func:`word_odds`; its slope by the bias, the loss, rows."""
    z = odds(weights, bias, ids, sizes)
    off = _chances(z) - labels
    words = np.bincount(ids, np.repeat(off / np.maximum(sizes, 1), sizes), len(weights))
    loss = np.logaddexp(0, z) - labels * z
    return words, np.array([off.sum(), loss.sum(), len(labels)])


def _chained(layers: dict[str, np.ndarray], words: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
    return {
        "embedding": np.outer(words, layers["output"]),
        "output": words @ layers["embedding"],
        "bias": sums[:1],
        "_sums": sums[1:],
    }


def gradients(layers: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over rows of the loss's gradients, of the loss itself and of rows."""
    return _chained(layers, *slopes(word_odds(layers), layers["bias"][0], ids, sizes, labels))


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids.flatten().to_numpy(zero_copy_only=False), sizes


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the first column as bytes: a step's rows travel to tasks in one piece, not id by id."""
    for batch in batches:
        ids, sizes = _flat(batch.column(0))
        ends = np.cumsum(sizes).tolist()
        ids = ids.astype(np.int32)
        packed = [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], batch.schema.names)


def _step_gradients(rows: DataFrame, layers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    held = rows.sparkSession.sparkContext.broadcast((word_odds(layers), layers["bias"][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part, texts, labels in _chunks(batches):
            sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // 4
            found = slopes(*held.value, np.frombuffer(b"".join(texts), np.int32), sizes, np.array(labels, np.float64))
            totals[part] = tuple(map(np.add, totals[part], found)) if part in totals else found
        packed = [pa.array([found[i].tobytes() for found in totals.values()], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), *packed], ["part", "words", "sums"])

    rows = rows.select("part", "ids", "label").coalesce(STEP_TASKS)
    found = sorted(rows.mapInArrow(run, "part int, words binary, sums binary").collect())
    held.unpersist()
    words = sum((np.frombuffer(r["words"]) for r in found), np.zeros(len(layers["embedding"])))
    return _chained(layers, words, sum((np.frombuffer(r["sums"]) for r in found), np.zeros(3)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """Rows of one part, up to ``_CHUNK`` bytes of them, wherever Arrow's batches end."""
    now, texts, labels, size = None, [], [], 0
    for batch in batches:
        for part, ids, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if texts and (part != now or size >= _CHUNK):
                yield now, texts, labels
                texts, labels, size = [], [], 0
            now, size = part, size + len(ids)
            texts.append(ids)
            labels.append(label)
    if texts:
        yield now, texts, labels


def fit_embedding(
    train: DataFrame, id_column: str, options: EmbeddingOptions = EmbeddingOptions(), text: str = "text", label: str = "label"
) -> EmbeddingModel:
    """Fit on rows with a label of 0 or 1; others are left out."""
    if unknown := set(options.frozen) - {"embedding", "output", "bias"}:
        raise ValueError(f"no layers {sorted(unknown)}")
    spark, path = train.sparkSession, scratch_path(train.sparkSession, "batches")
    dealt = F.xxhash64(F.col(id_column), F.lit(options.seed))
    rows = train.where(F.col(label).isin(0, 1)).select(
        bucket_ids(F.col(text), options.buckets).alias("ids"),
        F.col(label).cast("int").alias("label"),
        F.pmod(dealt, F.lit(options.batches)).cast("int").alias("batch"),
        F.pmod(F.xxhash64(dealt), F.lit(STEP_TASKS)).cast("int").alias("part"),
    ).mapInArrow(_packed, "ids binary, label int, batch int, part int")
    # Sorted, so that files and sums don't depend on how the rows came.
    parts = rows.repartition(options.batches * STEP_TASKS, "batch", "part").sortWithinPartitions("batch", "part", "label", "ids")
    parts.write.partitionBy("batch").parquet(path)
    model = EmbeddingModel(first_layers(options))
    table = spark.read.schema("ids binary, label int, part int, batch int").parquet(path)
    order = np.random.default_rng(options.seed)
    steps = options.epochs * options.batches
    for epoch in range(options.epochs):
        for place, batch in enumerate(order.permutation(options.batches).tolist()):
            found = _step_gradients(table.where(F.col("batch") == batch), model.layers)
            loss, n = found.pop("_sums")
            if not n:
                continue
            rate = rate_at(epoch * options.batches + place, steps, options)
            for name, value in found.items():
                if name not in options.frozen:
                    # An embedding row gets a share of its texts' gradients alone.
                    scale = options.size if name == "embedding" else 1
                    model.layers[name] = model.layers[name] * (1 - rate * options.weight_decay) - rate * scale * value / n
            model.losses.append(float(loss / n))
    return model


def embedding_scorer(model: EmbeddingModel, df: DataFrame, text_column: str = "text") -> Scorer:
    """Adds ``probabilities`` of the two classes; one number per embedding row goes to the tasks."""
    held = df.sparkSession.sparkContext.broadcast((word_odds(model.layers), model.layers["bias"][0]))

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            sizes = np.array([len(x) for x in lists], np.int64)
            ids = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.empty(0, np.int64)
            one = _chances(odds(*held.value, ids, sizes))
            yield pd.Series(np.stack([1 - one, one], axis=1).tolist())

    return lambda rows: rows.withColumn("probabilities", probabilities(bucket_ids(F.col(text_column), model.buckets)))
