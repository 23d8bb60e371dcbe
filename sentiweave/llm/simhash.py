"""SimHash near-duplicates through a vantage-point tree over Hamming distances.

A text's fingerprint has 64 bits: bit i is set when more than half of its shingles' hashes
have it. Equal fingerprints are taken together first, so that a group of copies is one row.
The tree is built from a bounded sample: each node has a vantage point v and a radius r and
sends fingerprints with d(x, v) <= r inside, the others outside. For two fingerprints at
most ``bits`` apart the triangle inequality bounds the difference of their distances to v,
so if a node parts them, the outer one has d(x, v) <= r + bits: such fingerprints go to
*both* sides, and every pair meets in some shard. Within its shard a task goes on with
vantage points of its own until the parts are small enough to compare all.

A shard yields links to the smallest fingerprint of each connected part instead of all
pairs: linear output, and the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut_lineage, plus, share, table
from .components import components

WORDS = 3
BITS = 2
#: Bound on the fingerprints that the tree's vantage points and radii are fitted on.
SAMPLE = 100_000
#: Fingerprints in a shard, as aimed at; a shard may have any number.
SHARD = 4_096
#: Parts of so many fingerprints are compared directly.
DIRECT = 256
#: Pairs that are compared at a time.
BLOCK = 1 << 20


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each ``words``-word shingle of the text in lower case (A-Z)."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(found) - words] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(found) - words + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """A 64-bit number with the bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[start : start + 65_536].astype("<u8")).view(np.uint8)
        bits = np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the fingerprint as a signed long of every row; null texts have no words."""
    schema = plus(docs.select(*keep).schema, "fingerprint long")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        *kept, texts = batch.columns
        made = np.array([majority_bits(shingle_hashes(t or "", words)) for t in texts.to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*kept, pa.array(made.view(np.int64))], schema.names)

    return arrow_map(docs.select(*keep, "text"), schema, rows)


def distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def _split(points: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that double the fewest points and part the others well."""
    best, least = None, np.inf
    for vantage in rng.choice(points, min(8, len(points)), replace=False):
        far = distance(points, vantage)
        inside = np.cumsum(np.bincount(far, minlength=65 + bits))
        for radius in range(64):
            both = inside[radius + bits] - inside[radius]
            outer = len(points) - inside[radius]
            largest = max(inside[radius] + both, outer)
            # Levels grow as 1 / log(1 / share of the larger side), copies as 1 + share of both.
            if largest >= 0.9 * len(points):
                continue
            cost = np.log1p(both / len(points)) / -np.log(largest / len(points))
            if cost < least:
                best, least = (vantage, radius), cost
    return best


class VantageTree:
    """Nodes as arrays; ``leaves`` numbers the shards."""

    def __init__(self, sample: np.ndarray, leaf: int, bits: int = BITS, seed: int = 5):
        self.bits = bits
        self.vantage: list[np.uint64] = []
        self.radius: list[int] = []
        self.child: list[list[int]] = []  # node number, or -1 - shard
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample), leaf, rng)

    def _grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        found = _split(points, self.bits, rng) if len(points) > leaf else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.vantage)
        self.vantage.append(found[0])
        self.radius.append(found[1])
        self.child.append([0, 0])
        far = distance(points, found[0])
        inner, outer = far <= found[1] + self.bits, far > found[1]
        self.child[node] = [self._grow(points[inner], leaf, rng), self._grow(points[outer], leaf, rng)]
        return node

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the point and shard, for all shards that each point belongs to."""
        rows, leaves = [], []
        waiting = [(self.root, np.arange(len(points)))]
        while waiting:
            node, index = waiting.pop()
            if node < 0:
                rows.append(index)
                leaves.append(np.full(len(index), -1 - node))
                continue
            far = distance(points[index], self.vantage[node])
            inner, outer = far <= self.radius[node] + self.bits, far > self.radius[node]
            waiting += [(self.child[node][0], index[inner]), (self.child[node][1], index[outer])]
        return np.concatenate(rows), np.concatenate(leaves)


class _Parts:
    """Union-find over positions, with the smallest member as root."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _tie_near(points: np.ndarray, index: np.ndarray, parts: _Parts, bits: int, rng: np.random.Generator) -> None:
    """Tie all pairs among ``points[index]`` that are near; splits large sets further."""
    waiting = [index]
    while waiting:
        index = waiting.pop()
        here = points[index]
        found = _split(here, bits, rng) if len(index) > DIRECT else None
        if found is not None:
            far = distance(here, found[0])
            waiting += [index[far <= found[1] + bits], index[far > found[1]]]
            continue
        step = max(1, BLOCK // max(1, len(index)))
        for start in range(0, len(index), step):
            some = here[start : start + step]
            near = np.bitwise_count(some[:, None] ^ here[None, start:]) <= bits
            left, right = np.nonzero(near)
            one, other = index[left + start], index[right + start]
            new = one < other
            one, other = one[new], other[new]
            while len(one):  # a few rounds of array steps tie what is new
                a, b = _roots(parts.up, one), _roots(parts.up, other)
                new = a != b
                if not new.any():
                    break
                a, b, one, other = a[new], b[new], one[new], other[new]
                np.minimum.at(parts.up, np.maximum(a, b), np.minimum(a, b))


def _roots(up: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = up[at]
    while True:
        above = up[root]
        if (above == root).all():
            return root
        root = above


def near_links(prints: DataFrame, total: int, bits: int = BITS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """a and b: links that connect all fingerprints at most ``bits`` apart, directly or not.

    prints: one row for each distinct fingerprint (column ``fingerprint``), ``total`` rows.
    """
    rate = 1.0 if total <= sample else sample / total
    chosen = prints.select("fingerprint").where(
        F.pmod(F.xxhash64(F.lit("sample"), "fingerprint"), F.lit(1_000_000)) < int(rate * 1_000_000)
    ).limit(2 * sample)
    points = np.array([r[0] for r in chosen.toLocalIterator()], np.int64).view(np.uint64)
    tree = VantageTree(points, max(64, int(shard * rate)), bits)
    shared = share(prints.sparkSession, tree)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        row, leaf = shared().shards(own.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(leaf)], ["fingerprint", "shard"])

    placed = arrow_map(prints.select("fingerprint"), "fingerprint long, shard long", place)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; only one shard's fingerprints are held."""
        shard, held = None, []
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            leaf = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            for part, at in zip(np.split(own, cuts), np.concatenate(([0], cuts)), strict=True):
                if not len(part):
                    continue
                if leaf[at] != shard and held:
                    yield tied(held)
                    held = []
                shard = leaf[at]
                held.append(part)
        if held:
            yield tied(held)

    def tied(held: list[np.ndarray]) -> pa.RecordBatch:
        points = np.unique(np.concatenate(held))
        parts = _Parts(len(points))
        _tie_near(points.view(np.uint64), np.arange(len(points)), parts, bits, np.random.default_rng(11))
        root = _roots(parts.up, np.arange(len(points)))
        new = root != np.arange(len(points))
        return pa.RecordBatch.from_arrays([pa.array(points[new]), pa.array(points[root[new]])], ["a", "b"])

    count = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        placed.repartition(count, "shard").sortWithinPartitions("shard").mapInArrow(tie, "a long, b long")
    )


def group_roots(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """``distinct`` (a row for each fingerprint) with ``root``, the same for all that links reach."""
    found = components(near_links(distinct, distinct.count(), bits)).withColumnRenamed("node", "fingerprint")
    return distinct.join(found, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of every row of ``docs``.

    component_id is the smallest doc_id that links reach. Texts without words have
    fingerprint zero and link as any other. Rows that repeat a doc_id are linked as any
    others; a null doc_id is never a component_id unless a component has no other.
    """
    prints = cut_lineage(fingerprints(docs, words))
    groups = group_roots(cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))), bits)
    smallest = groups.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = groups.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def one_of_each_group(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, all columns as they are.

    Null ids come last; of rows that repeat an id the one with the smallest hash of the row
    stays, and of rows that are equal altogether one. Columns may have any names.
    """
    quoted = {c: F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns}
    hashable = [c for c in quoted if "map<" not in docs.select(quoted[c]).schema[0].dataType.simpleString()]
    # Inner names can't clash with the frame's own: its columns travel in one struct.
    packed = docs.select(
        F.struct(*quoted.values()).alias("row"),
        quoted["doc_id"].alias("doc_id"),
        quoted["text"].alias("text"),
        F.xxhash64(*(quoted[c] for c in hashable)).alias("h1"),
        F.xxhash64(F.lit("second"), *(quoted[c] for c in hashable)).alias("h2"),
    )
    prints = cut_lineage(fingerprints(packed, words, ("doc_id", "h1", "h2")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    lowest = cut_lineage(prints.groupBy("fingerprint").agg(F.min(key).alias("low")))
    keepers = group_roots(lowest, bits).groupBy("root").agg(F.min("low").alias("low")).select("low.h1", "low.h2")
    kept = packed.join(keepers, ["h1", "h2"], "left_semi")
    if not prints.groupBy("h1", "h2").count().where("count > 1").limit(1).isEmpty():
        kept = kept.dropDuplicates(["h1", "h2"])
    return kept.select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")
