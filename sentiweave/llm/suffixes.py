"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

Every string of ``length`` bytes starts at some position; a position is repeated if the
same string starts anywhere else. Texts hold too many positions to move them all, so each
is given to an anchor: of the 64-byte grams inside of its string, the (leftmost) one with
the smallest polynomial hash. Equal strings have equal anchors at equal places in them, so
only positions with the same anchor hash and the same distance to it need be compared, and
positions of one anchor form a run whose strings lie in one *span* of bytes.

1. Anchor hashes that occur once are dropped by a counting aggregate.
2. Of equal spans (128 bits of hash) one stands for all. A span that occurs twice is
   repeated throughout.
3. The spans of an anchor hash are brought together and the suffixes at their anchors are
   sorted: a mergesort whose comparisons find the common extension of two suffixes by
   binary search over prefix polynomial hashes, in a logarithmic number of steps. Strings
   that agree behind and before their anchors are compared byte by byte, and are repeated.
4. An anchor hash with very many different spans (a passage in ever different places) isn't
   given to one task: its positions are dealt by a hash of their string and counted.

Polynomials are taken modulo 2^64 over random byte values; what they say is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_A_TIME, arrow_map, table, written

LENGTH = 200
GRAM = 64
#: Anchors with more different spans are dealt by string (step 4).
SPANS = 32_768
#: Window starts handled at a time in a text, and bytes of spans sorted at a time.
SEGMENT = 1 << 16
SORT_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            most = max(size, 2 * len(self.up), SEGMENT + 512)
            self.up, self.down = (
                np.concatenate((np.ones(1, np.uint64), np.full(most - 1, factor, np.uint64))).cumprod(dtype=np.uint64)
                for factor in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        return self.up[:size], self.down[:size]


def prefix_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    """H with H[j] - H[i] = base^i times the hash of data[i:j]."""
    up, _ = powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:-1], dtype=np.uint64, out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _smallest(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each window of ``keys``, by doubling."""
    width = 1
    while 2 * width <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = window - width
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def anchor_runs(data: np.ndarray, length: int, gram: int, powers: Powers) -> list[np.ndarray]:
    """start, count, offset and anchor hash of the runs of positions in a text: the count
    positions from start on have the anchor at start + offset."""
    parts = []
    place = np.uint64((1 << 17) - 1)
    for begin in range(0, len(data) - length + 1, SEGMENT):
        part = data[begin : begin + SEGMENT + length - 1]
        prefix = prefix_hashes(part, powers)
        _, down = powers.upto(len(part) + 1)
        grams = _mixed((prefix[gram:] - prefix[:-gram]) * down[: len(part) - gram + 1])
        keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_smallest(keys, length - gram + 1) & place).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        count = np.diff(np.concatenate((first, [len(anchor)])))
        parts.append(np.stack([first + begin, count, anchor[first] - first, grams[anchor[first]].view(np.int64)]))
    return list(np.concatenate(parts, axis=1)) if parts else [np.empty(0, np.int64)] * 4


def text_key(*columns: str) -> Column:
    """128 bits of hash of a row, as 16 bytes."""
    halves = (F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns))
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def text_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """row, start, count, offset, anchor (hash) and span (hash) of all runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_A_TIME):
                some = batch.slice(begin, ROWS_AT_A_TIME)
                found = []
                for row, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    if len(raw) < length:
                        continue
                    start, count, offset, anchor = anchor_runs(np.frombuffer(raw, np.uint8), length, gram, powers)
                    seeds = (offset * length + count).tolist()
                    ends = (start + count + (length - 1)).tolist()
                    spans = [
                        digest(raw[a:b], seed) for a, b, seed in zip(start.tolist(), ends, seeds, strict=True)
                    ]
                    found.append(
                        (pa.repeat(pa.scalar(row, pa.binary()), len(start)), start, count, offset, anchor,
                         np.array(spans, np.uint64).view(np.int64))
                    )
                if found:
                    rows, *columns = zip(*found, strict=True)
                    kinds = (np.int64, np.int32, np.int32, np.int64, np.int64)
                    made = (pa.array(np.concatenate(c).astype(k)) for c, k in zip(columns, kinds, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *made], RUN.split())

    schema = "row binary, start long, count int, offset int, anchor long, span long"
    return docs.select("row", "text").mapInArrow(run, schema)


RUN = "row start count offset anchor span"


class SuffixSort:
    """Suffixes of a text, each up to a limit of its own, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.data = data
        self.prefix = prefix_hashes(data, powers)
        self.down = powers.upto(len(data) + 1)[1]

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at a and b, at most ``most``."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        whole = self.hashes(a, high) == self.hashes(b, high)
        low[whole] = high[whole]
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            same = self.hashes(a, middle) == self.hashes(b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(low, middle - 1))
        return low

    def order(self, at: np.ndarray, limit: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes by group (ascending already) and text: a bottom-up mergesort.

        All merges of a level are made at once: a suffix's new place is its place in its
        own run plus its rank, found by binary search, in the run beside it.
        """

        def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
            most = np.minimum(limit[x], limit[y])
            size = self.common(at[x], at[y], most)
            inside = np.minimum(size, most - 1)
            by_length = np.where(limit[x] == limit[y], or_equal, limit[x] < limit[y])
            return np.where(size == most, by_length, self.data[at[x] + inside] < self.data[at[y] + inside])

        begin = np.searchsorted(group, group)  # first of each one's group
        local = np.arange(len(at)) - begin
        size = np.searchsorted(group, group, "right") - begin
        order = np.arange(len(at))  # order[p]: the suffix at place p
        width = 1
        while len(at) and width < size.max():
            place = np.arange(len(at))[size > width]  # groups that still have two runs
            inside = local[place]
            own = inside // width
            other = begin[place] + (own ^ 1) * width
            end = np.minimum(other + width, begin[place] + size[place])
            low, high = other.copy(), np.maximum(end, other)
            one = order[place]
            right = own % 2 == 1
            while (low < high).any():
                open_ = low < high
                middle = (low[open_] + high[open_]) // 2
                # A right suffix passes equal left ones, a left one stays before right ones.
                passed = before(order[middle], one[open_], right[open_])
                low[open_] = np.where(passed, middle + 1, low[open_])
                high[open_] = np.where(passed, high[open_], middle)
            target = begin[place] + (own - own % 2) * width + (inside - own * width) + (low - other)
            new = order.copy()
            new[target] = order[place]
            order = new
            width *= 2
        return order


def sort_spans(rows: list[tuple[int, int, int, int, bytes]], length: int, powers: Powers) -> list[list[dict]]:
    """For (anchor, span, offset, count, bytes) of whole anchor groups: the runs of repeated
    positions of each, as first and end (exclusive) relative to the span's start.

    The suffixes that start at the anchors are sorted. What two of them have in common
    behind the anchor is the least of the extensions between their neighbours, so the ones
    that agree on any number of bytes lie side by side. A string that starts ``d`` bytes
    before its anchor is repeated if, of those that agree on the ``length - d`` bytes from
    the anchor on, another has the same ``d`` bytes before it.
    """
    sizes = np.array([len(r[4]) for r in rows])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    offset, count = (np.array([r[i] for r in rows]) for i in (2, 3))
    group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
    at, limit = base + offset, sizes - offset
    sort = SuffixSort(data, powers)
    order = sort.order(at, limit, group)
    a, b = order[:-1], order[1:]
    most = np.where(group[a] == group[b], np.minimum(limit[a], limit[b]), 0)
    extension = np.concatenate(([-1], np.where(group[a] == group[b], sort.common(at[a], at[b], most), -1)))
    found = np.zeros(int(count.sum()), bool)
    first = np.cumsum(count) - count
    at, offset, count, first = at[order], offset[order], count[order], first[order]
    steps = np.arange(length)
    for d in range(int((offset - count + 1).min()), int(offset.max()) + 1):
        block = np.cumsum(extension < length - d)
        own = np.flatnonzero((offset - count < d) & (d <= offset))
        block, left = block[own], sort.hashes(at[own] - d, d)
        by = np.lexsort((left, block))
        same = np.flatnonzero((block[by[1:]] == block[by[:-1]]) & (left[by[1:]] == left[by[:-1]]))
        one, other = own[by[same]], own[by[same + 1]]
        for begin in range(0, len(one), 4_096):
            x, y = (p[begin : begin + 4_096] for p in (one, other))
            if not (data[(at[x] - d)[:, None] + steps] == data[(at[y] - d)[:, None] + steps]).all():
                return _by_bytes(rows, length)  # two strings with one hash
            found[first[x] + offset[x] - d] = found[first[y] + offset[y] - d] = True
    return [_intervals(part) for part in np.split(found, np.cumsum([r[3] for r in rows])[:-1])]


def _by_bytes(rows: list[tuple[int, int, int, int, bytes]], length: int) -> list[list[dict]]:
    """As :func:`sort_spans`, where hashes have failed."""
    places: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
    for i, (anchor, _, offset, count, raw) in enumerate(rows):
        for j in range(count):
            places.setdefault((anchor, offset - j, raw[j : j + length]), []).append((i, j))
    found = [np.zeros(r[3], bool) for r in rows]
    for own in places.values():
        for i, j in own:
            found[i][j] = len(own) > 1
    return [_intervals(f) for f in found]


def _intervals(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_PARTS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
_FOUND = "anchor long, span long, parts array<struct<first:int,end:int>>"


def _sorted_groups(length: int):
    """Rows come sorted by anchor; groups are sorted together up to SORT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held, size = [], 0
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(5))
            for row in zip(*columns, strict=True):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield out(held, powers)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out(held, powers)

    def out(held, powers) -> pa.RecordBatch:
        parts = sort_spans(held, length, powers)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in held]), pa.array([r[1] for r in held]), pa.array(parts, _PARTS)],
            ["anchor", "span", "parts"],
        )

    return run


def span_bytes(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """anchor, span, offset, count, bytes: cut out of the text that stands for the span."""
    wanted = spans.groupBy("row").agg(F.collect_list(F.struct("anchor", "span", "offset", "count", "start")).alias("wanted"))
    schema = "anchor long, span long, offset int, count int, bytes binary"
    names = ["anchor", "span", "offset", "count", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode()
            for w in wanted:
                cut = raw[w["start"] : w["start"] + w["count"] + length - 1]
                out.append((w["anchor"], w["span"], w["offset"], w["count"], cut))
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    found = arrow_map(docs.join(wanted, "row").select("text", "wanted"), schema, rows)
    return found


def _string_hashes(length: int):
    """anchor, span, at and two hashes of the string at each position of a span."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        powers = Powers()
        for anchor, span, offset, count, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            prefix = prefix_hashes(np.frombuffer(raw, np.uint8), powers)
            down = powers.upto(len(raw) + 1)[1]
            at = np.arange(count)
            one = _mixed((prefix[at + length] - prefix[at]) * down[at]).view(np.int64)
            two = [xxhash.xxh3_64_intdigest(raw[i : i + length]) for i in range(count)]
            out.append((np.full(count, anchor), np.full(count, span), at, one, np.array(two, np.uint64).view(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in columns], ["anchor", "span", "at", "one", "two"]
        )

    return rows


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_spans: int = SPANS) -> DataFrame:
    """row, first and end (exclusive): runs of positions of texts whose strings are repeated.

    docs: row (a key of the text) and text, without nulls. Rows with one key are occurrences
    of their own.
    """
    runs = text_runs(docs, length, gram)
    # Written, so that both sides of the join are shuffled and hot anchors can be split.
    often = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    met = written(runs.join(often, "anchor").select(*RUN.split()))
    spans = written(
        met.groupBy("anchor", "span").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "start", "offset", "count")).alias("x")
        ).select("anchor", "span", "n", "x.*")
    )
    kinds = spans.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = spans.join(kinds, "anchor")
    raw = written(span_bytes(docs, several, length).join(kinds, "anchor"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_tasks = (
        raw.where(F.col("kinds") <= most_spans)
        .select("anchor", "span", "offset", "count", "bytes")
        .repartition(partitions, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_sorted_groups(length), _FOUND)
        .select("anchor", "span", F.inline("parts"))
    )
    strings = arrow_map(
        raw.where(F.col("kinds") > most_spans).select("anchor", "span", "offset", "count", "bytes"),
        "anchor long, span long, at long, one long, two long",
        _string_hashes(length),
    )
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    dealt = strings.join(twice, ["one", "two"]).select(
        "anchor", "span", F.col("at").cast("int").alias("first"), (F.col("at") + 1).cast("int").alias("end")
    )
    whole = spans.where("n > 1").select("anchor", "span", F.lit(0).alias("first"), F.col("count").alias("end"))
    found = written(whole.unionByName(in_tasks).unionByName(dealt))
    return met.join(found, ["anchor", "span"]).select(
        "row", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end")
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_spans: int = SPANS) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left, binary) and spans (removed runs: first, end).

    docs: doc_id, text. Every byte that a repeated string of ``length`` bytes covers is
    removed, wherever the string starts again: in another text or the same one. A null
    text counts as empty; texts below ``length`` bytes keep all. Repeated rows are
    occurrences of their own, so what they say is removed from all of them.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram is at most as long as the strings")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "row", text_key("doc_id", "text")
    )
    runs = repeated_runs(keyed.select("row", "text"), length, gram, most_spans)
    per_row = runs.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("runs"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, spans = [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, own, out, at = text.encode(), [], [], 0
            for first, end in sorted((r["first"], r["end"] + length - 1) for r in runs or ()):
                if own and first <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], end)
                else:
                    own.append({"first": first, "end": end})
            for x in own:
                out.append(raw[at : x["first"]])
                at = x["end"]
            kept.append(b"".join([*out, raw[at:]]))
            spans.append(own)
        sizes = pa.array([len(k) + sum(x["end"] - x["first"] for x in own) for k, own in zip(kept, spans, strict=True)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), sizes.cast(pa.int64()), pa.array(kept, pa.binary()),
             pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_bytes", "kept", "spans"],
        )

    joined = keyed.join(per_row, "row", "left").select("doc_id", "text", "runs")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        joined, f"doc_id {id_type}, n_bytes long, kept binary, spans array<struct<first:long,end:long>>", rows
    )


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
