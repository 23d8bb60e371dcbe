"""Benchmark decontamination by winnowing.

Of the k-grams of words in each window of w neighbouring ones the one with the smallest
hash is kept. Whatever k + w - 1 words a text and an item share, the smallest hash of that
window is kept in both, so every shared span of that length meets in the join; k = 5 and
w = 6 guarantee it for the 10 words of a window. A kept k-gram carries the words around it
that a common window can hold, and a hit is extended over them word by word, so that hash
collisions change nothing. Items of fewer words than a window are k-grams as a whole.

A bit table of fixed size over the items' hashes tells a scanning task which k-grams can't
meet any item. It may err on one side only: the join after it decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, plus, share, table

WINDOW = 10
GRAM = 5
#: log2 of the bits in the table of the items' hashes: 2 MB, whatever the benchmark's size.
TABLE_BITS = 24
REMEMBERED_WORDS = 100_000

#: Bytes that belong to no word become spaces; A-Z becomes a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)
_FIELDS = "struct<gram:long,at:int,left:array<binary>,right:array<binary>>"
_GRAM_TYPE = pa.list_(
    pa.struct(
        [("gram", pa.int64()), ("at", pa.int32()), ("left", pa.list_(pa.binary())), ("right", pa.list_(pa.binary()))]
    )
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class WordHashes(dict):
    """word -> XXH64, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def __reduce__(self):
        return WordHashes, ()


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``size`` words, which names ``size`` too."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window (its last one on ties), ascending."""
    count = len(grams) - window + 1
    if count <= 0:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    last = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(count) + last)


def _with_grams(rows: list[list[bytes]], chosen) -> list[list[dict]]:
    """chosen(words) gives (size, reach, hash, position) of the k-grams to carry."""
    out = []
    for words in rows:
        out.append(
            [
                {
                    "gram": int(np.uint64(h).view(np.int64)),
                    "at": at,
                    "left": words[max(0, at - reach) : at][::-1],
                    "right": words[at : at + size + reach],
                }
                for size, reach, h, at in chosen(words)
            ]
        )
    return out


def item_grams(items: DataFrame, window: int, gram: int) -> DataFrame:
    """gram, at, left, right and item_id of every k-gram kept of an item, and its size."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory = WordHashes()

        def chosen(words):
            own = np.array([memory[w] for w in words], np.uint64)
            if not len(words):
                return
            size, reach = (gram, window - gram) if len(words) >= window else (len(words), 0)
            grams = gram_hashes(own, size)
            for at in winnow(grams, window - gram + 1 if reach else 1):
                yield size, reach, grams[at], int(at)

        texts = [words_of(t or "") for t in batch.column(1).to_pylist()]
        sizes = [min(len(t), window) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int32()), pa.array(_with_grams(texts, chosen), _GRAM_TYPE)],
            ["item_id", "size", "grams"],
        )

    schema = plus(items.select("item_id").schema, f"size int, grams array<{_FIELDS}>")
    found = arrow_map(items.select("item_id", "text"), schema, rows)
    return found.select("item_id", "size", F.inline("grams"))


def bit_table(items: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """A bit for the lower ``bits`` bits of each gram; at most 2^(bits-6) rows are fetched."""
    low = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        items.groupBy(F.shiftright(low, 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(gram & 63 as int))")).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    for row in rows:
        out[row["word"]] = np.int64(row["bits"]).view(np.uint64)
    return out


def document_grams(docs: DataFrame, sizes: list[int], bits: np.ndarray, window: int, gram: int) -> DataFrame:
    """doc_id, key (hash of the text), n_words and the k-grams that may meet an item.

    ``sizes``: lengths of the items that are shorter than a window.
    """
    mask = np.uint64(len(bits) * 64 - 1)
    shared = share(docs.sparkSession, (bits, WordHashes()))

    def known(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = grams & mask
        return (table[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) != 0

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, memory = shared()

        def chosen(words):
            own = np.array([memory[w] for w in words], np.uint64)
            grams = gram_hashes(own, gram)
            kept = winnow(grams, window - gram + 1)
            for at in kept[known(grams[kept], table)]:
                yield gram, window - gram, grams[at], int(at)
            for size in sizes:
                grams_ = gram_hashes(own, size)
                for at in np.flatnonzero(known(grams_, table)):
                    yield size, 0, grams_[at], int(at)

        texts = [words_of(t or "") for t in batch.column(2).to_pylist()]
        counts = pa.array(list(map(len, texts)), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), counts, pa.array(_with_grams(texts, chosen), _GRAM_TYPE)],
            ["doc_id", "key", "n_words", "grams"],
        )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    schema = plus(keyed.select("doc_id", "key").schema, f"n_words long, grams array<{_FIELDS}>")
    return arrow_map(keyed, schema, rows)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the span of document words that its extended hit covers, if any."""
    for batch in batches:
        index = batch.schema.get_field_index
        column = lambda name: batch.column(index(name)).to_pylist()
        hit, first, end = [], [], []
        rows = zip(*map(column, ("at", "left", "right", "i_left", "i_right", "size")), strict=True)
        for at, left, right, i_left, i_right, size in rows:
            before, after = (_common(left, i_left), _common(right, i_right)) if at is not None and size else (0, -1)
            hit.append(before + after >= (size or 1))
            first.append(at - before if hit[-1] else None)
            end.append(at + after if hit[-1] else None)
        items = batch.column(index("item_id"))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(index(c)) for c in ("doc_id", "key", "n_words")),
                pc.if_else(pa.array(hit, pa.bool_()), items, pa.scalar(None, items.type)),
                pa.array(first, pa.int32()),
                pa.array(end, pa.int32()),
            ],
            ["doc_id", "key", "n_words", "item_id", "first", "end"],
        )


def _common(left: list[bytes], right: list[bytes]) -> int:
    for n, (a, b) in enumerate(zip(left, right, strict=False)):
        if a != b:
            return n
    return min(len(left), len(right))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit words and item_ids, sorted as strings.

    docs: doc_id, text. items: item_id, text. A word is hit that lies inside of an
    occurrence of ``window`` consecutive words of an item, or of all words of an item with
    fewer. Null texts have no words, and items without words hit nothing; null item_ids
    are left out of ``item_ids`` but hit words. Rows that repeat a doc_id with the same
    text give one row, with another text a row each; ``key`` is the text's hash.
    """
    kept = item_grams(items.select("item_id", "text"), window, gram)
    sizes = [r["size"] for r in kept.where(F.col("size") < window).select("size").distinct().orderBy("size").collect()]
    found = document_grams(docs, sizes, bit_table(kept), window, gram)
    # A document without k-grams still gets a row; it is dealt by its own key, not by null.
    rows = found.select("doc_id", "key", "n_words", F.inline_outer("grams")).withColumn(
        "gram", F.coalesce("gram", F.xxhash64("doc_id", "key"))
    )
    item_side = kept.select(
        "item_id", "size", "gram", F.col("left").alias("i_left"), F.col("right").alias("i_right")
    )
    met = rows.join(item_side, "gram", "left")
    schema = plus(met.select("doc_id", "key", "n_words", "item_id").schema, "first int, end int")
    spans = F.sort_array(F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "end"))))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        "spans",
        none,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["end"]).alias("end"),
            (s["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], s["end"]))).cast("long").alias("total"),
        ),
        lambda s: s["total"],
    )
    return (
        met.mapInArrow(_extend, schema)
        .groupBy("doc_id", "key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
            spans.alias("spans"),
        )
        .select("doc_id", "key", "n_words", covered.alias("n_hit"), "item_ids")
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit word, all columns as they are."""
    hit = contamination(docs, items).where("n_hit > 0").select(
        F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")
    )
    same = docs["doc_id"].eqNullSafe(hit["_doc_id"]) & (F.xxhash64(docs["text"]) == hit["_key"])
    return docs.join(hit, same, "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
it AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS k
  FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM it)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM it))
), hit AS (
  SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (k, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
