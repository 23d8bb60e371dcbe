"""Scoring by an outside model in padded batches of similar length.

Rows are put in order of their length inside of their partition, so that a batch holds little
padding, and a batch takes as many rows as its budget of tokens allows. A worker loads the
model once and keeps it for its later tasks. No row is shuffled, and all columns come through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Padded tokens of a batch.
TOKENS_PER_BATCH = 1 << 16

#: Takes ids and mask (rows x longest) and gives logits (rows x classes).
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: The model that a worker has loaded, by the application's name for it.
_LOADED: dict[str, Model] = {}


def batch_ends(sizes: np.ndarray, budget: int) -> list[int]:
    """Ends of consecutive batches with at most ``budget`` padded tokens, one row at least."""
    ends, start, longest = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        longest = max(longest, size)
        if i > start and longest * (i + 1 - start) > budget:
            ends.append(i)
            start, longest = i, size
    return [*ends, len(sizes)] if len(sizes) else []


def padded(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (rows x longest, zero behind a row's end) and mask of rows that lie one after the other."""
    mask = np.arange(max(1, int(sizes.max(initial=0))))[None, :] < sizes[:, None]
    ids = np.zeros(mask.shape, np.int64)
    ids[mask] = values
    return ids, mask


def score_by_length(
    df: DataFrame,
    ids: str,
    load: Callable[[], Model],
    output: str = "logits",
    tokens_per_batch: int = TOKENS_PER_BATCH,
) -> DataFrame:
    """``df`` with the logits of every row; a null or empty list of ids is a row of padding alone."""
    if output in df.columns:
        raise ValueError(f"there is a column {output} already")
    name = uuid.uuid4().hex
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentiweave.plans.inference import _LOADED  # the worker's own

        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = load()
        model = _LOADED[name]
        for batch in batches:
            lists = batch.column(place)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            found, start = [], 0
            for end in batch_ends(sizes, tokens_per_batch):
                made = model(*padded(values[starts[start] : starts[end]], sizes[start:end]))
                found += np.asarray(made, np.float64).tolist()
                start = end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, output]
            )

    return df.sortWithinPartitions(F.size(F.col(ids))).mapInArrow(run, schema)
