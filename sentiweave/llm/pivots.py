"""Embedding near-duplicates through an index of pivot permutations.

Reference points (pivots) are drawn from a bounded sample. A vector is described by its
nearest pivots in order; it stands in the inverted list of each of them. Two vectors are
candidates if they share enough pivots, or one that is close to both, and candidates are
verified by their cosine in double precision. All vectors are indexed; only the pivots come
from a sample. No two pivots are close to each other: else a dense group of vectors would
supply many pivots, of which its members' nearest are told apart by noise alone.

Equal unit vectors are one row with a count.

A list is dealt to tasks in square blocks, so that a long one is neither held by a task nor
cut off. A pair that meets in several lists counts in the list of its smallest shared pivot
alone. Tasks return counts of links and the links to the smallest vector of each connected
part of a block, which is linear in the rows they read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, hash_pair, plus, share, table
from .components import components

THRESHOLD = 0.93
#: Pivots in a vector's description, and how many of them candidates share at least.
NEAREST = 6
SHARED = 2
#: Cosines: of two pivots at most, and of a pivot to vectors that need share no other with it.
APART, CLOSE = 0.8, 0.5
#: Bounds on the pivots and on the rows they are drawn from.
MIN_PIVOTS, MAX_PIVOTS, SAMPLE = 32, 1_024, 4_096
#: Aimed-at vectors of a label for each pivot; the pivots' number follows the largest label.
ROWS_PER_PIVOT = 40
#: Side of a block of pairs.
BLOCK = 2_048


def can_link() -> Column:
    """Whether a row of vec_id, embedding and label can link with any other."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    return F.coalesce(given & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and unit vector (doubles) of the rows that can link with any other."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return (
        vectors.where(can_link())
        .select("vec_id", "label", doubles.alias("v"))
        # Divided by the largest part first: squares neither vanish nor overflow.
        .withColumn("v", F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y)))))
        .withColumn("norm", norm)
        .select("vec_id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.size("v").alias("size"))
    )


def draw_pivots(vectors: DataFrame, largest: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit vectors by their length in components, at most MAX_PIVOTS in all for each, none close to another."""
    count = min(MAX_PIVOTS, max(MIN_PIVOTS, -(-largest // ROWS_PER_PIVOT)))
    rows = (
        vectors.select("size", "v", F.xxhash64(F.lit("pivot"), "vec_id").alias("h"))
        .orderBy("h")
        .limit(sample)
        .collect()
    )
    out: dict[int, list] = {}
    for row in rows:
        own = out.setdefault(row["size"], [])
        if len(own) < count:
            v = np.array(row["v"])
            if not own or (np.stack(own) @ v).max() <= APART:
                own.append(v)
    return {size: np.array(own) for size, own in out.items()}


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """``vectors`` with ``near``: the numbers of the nearest pivots, nearest first."""
    shared = share(vectors.sparkSession, pivots)

    def run(batches):
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
            column = batch.column(batch.schema.get_field_index("v"))
            near = [None] * batch.num_rows
            for size in np.unique(sizes):
                own = shared().get(int(size))
                at = np.flatnonzero(sizes == size)
                if own is None:  # a length that the sample doesn't have: one list for all
                    for i in at:
                        near[i] = [0]
                    continue
                x = np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), -1)
                take = min(nearest, len(own))
                cos = x @ own.T
                first = np.argpartition(-cos, take - 1, axis=1)[:, :take]
                order = np.argsort(-np.take_along_axis(cos, first, 1), axis=1, kind="stable")
                for i, row in zip(at, np.take_along_axis(first, order, 1).tolist(), strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "near"]
            )

    return vectors.mapInArrow(run, plus(vectors.schema, "near array<int>"))


def _links(left: np.ndarray, right: np.ndarray, near_l: np.ndarray, near_r: np.ndarray, close_l: np.ndarray, close_r: np.ndarray, pivot: int, shared: int, threshold: float):
    """Positions of the pairs that this list counts: verified, and this pivot is the first."""
    need = min(shared, near_l.shape[1], near_r.shape[1])
    # Pairs far below the threshold go first; how they share pivots is looked at for the others.
    a, b = np.nonzero(left @ right.T >= threshold - 1e-9)
    keep = np.empty(len(a), bool)
    for start in range(0, len(a), 65_536):  # verified as doubles, a few pairs at a time
        part = slice(start, start + 65_536)
        i, j = a[part], b[part]
        same = (near_l[i][:, :, None] == near_r[j][:, None, :]).any(2)
        first = np.where(same, near_l[i], np.iinfo(np.int32).max).min(1) == pivot
        enough = (same.sum(1) >= need) | (close_l[i] & close_r[j])
        keep[part] = first & enough & (np.einsum("ij,ij->i", left[i], right[j]) >= threshold)
    return a[keep], b[keep]


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each one is connected to."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def list_links(described: DataFrame, pivots: dict[int, np.ndarray], threshold: float = THRESHOLD, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links and root: for each block and vector in a link, counted once a pair.

    described: one row for each distinct vector, ``n`` rows of the table; a link counts as
    many as the other one's rows.
    """
    drawn = share(described.sparkSession, pivots)
    listed = described.select("vec_id", "label", "size", "n", "v", "near", F.explode("near").alias("pivot"))
    key = ["label", "size", "pivot"]
    lengths = described.select("label", "size", F.explode("near").alias("pivot")).groupBy(key).agg(
        F.ceil(F.count("*") / block).cast("int").alias("parts")
    )
    # Row of part p goes to the blocks (p, q) and (q, p): every pair of parts meets once.
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(F.least(q, F.col("part")).alias("one"), F.greatest(q, F.col("part")).alias("two")),
    )
    dealt = (
        listed.join(lengths, key)
        .withColumn("part", part)
        .select(*key, "vec_id", "n", "v", "near", "part", F.inline(blocks))
    )

    def run(at: tuple, rows: pa.Table) -> pa.Table:
        pivot, one, two = (x.as_py() for x in (at[2], at[3], at[4]))
        ids = rows["vec_id"].to_numpy()
        part = rows["part"].to_numpy()
        order = np.lexsort((ids, part))
        ids, part = ids[order], part[order]
        x = np.asarray(rows["v"].combine_chunks().flatten()).reshape(len(ids), -1)[order]
        near = np.asarray(rows["near"].combine_chunks().flatten()).reshape(len(ids), -1)[order]
        own = drawn().get(at[1].as_py())
        close = np.zeros(len(ids), bool) if own is None else x @ own[pivot] >= CLOSE
        n = rows["n"].to_numpy()[order]
        count, pairs = np.zeros(len(ids), np.int64), []
        left = np.flatnonzero(part == one)
        right = np.flatnonzero(part == two)
        for start in range(0, len(left), 512):
            some = left[start : start + 512]
            a, b = _links(x[some], x[right], near[some], near[right], close[some], close[right], pivot, shared, threshold)
            a, b = some[a], right[b]
            keep = a < b if one == two else a != b
            a, b = a[keep], b[keep]
            np.add.at(count, a, n[b])
            np.add.at(count, b, n[a])
            pairs.append((a, b))
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in (0, 1))
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        root = ids[by_id][_roots(len(ids), rank[a], rank[b])[rank]]
        found = count > 0
        return pa.table({"vec_id": ids[found], "n_links": count[found], "root": root[found]})

    return dealt.groupBy(*key, "one", "two").applyInArrow(run, "vec_id long, n_links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``.

    vectors: vec_id (long), embedding (array of numbers), label. Only vectors of the same
    label and length link, at a cosine of ``threshold`` or more. Vectors that are null, zero
    or hold null or non-finite parts, and those without label or vec_id, link with nothing;
    they are their own component. vec_ids are taken to be unique: rows that repeat one give
    a row each, with the row's own links.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    good = cut_lineage(usable(rows))
    largest = good.groupBy("label", "size").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    pivots = draw_pivots(good, largest)
    folded = good.groupBy("label", "size", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    described = cut_lineage(describe(folded, pivots, nearest))
    found = cut_lineage(list_links(described, pivots, threshold, shared))
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    key = hash_pair(F.col("v")).alias("key")
    own = (
        described.select("vec_id", "label", "size", key, "n")
        .join(counts, "vec_id", "left")
        .join(groups.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
        .select(
            "label",
            "size",
            "key",
            (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "vec_id").alias("component_id"),
        )
    )
    linked = good.select("vec_id", "label", "size", key).join(own, ["label", "size", "key"])
    alone = rows.where(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select(*alone.columns).unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True))
    )


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
