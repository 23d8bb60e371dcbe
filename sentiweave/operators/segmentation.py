"""Words of texts without spaces, and how subword pieces cut them.

A dictionary of bounded size (the most frequent words of a corpus with spaces, or any table of
words and counts) gives each word a cost, the negative logarithm of its share. A text is a
graph of positions with an arc for every dictionary word that stands at one, and for each
single character at the cost of a word rarer than all known ones; its words are the cheapest
path from its start to its end. Texts are cut where they lie: the dictionary goes to tasks,
which read it as a tree of characters, so that a position is left at the first character that
goes on to no word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiweave.functions.numeric import ratio
from sentiweave.functions.text import words
from sentiweave.operators.pairtable import SEPARATOR, Tree, code_points, text_of
from sentiweave.operators.subwords import Pieces, Subwords

#: Words that a dictionary has at most, and their length.
DICTIONARY_WORDS = 50_000
LONGEST_WORD = 24
#: Characters that are looked up at once, and how many of their beginnings a task remembers.
_STRIDE = 4
_REMEMBERED = 100_000
#: Bytes of texts that are cut side by side (a longer text alone), and the longest stretch that is.
_TOGETHER = 400_000
_STRETCH = 2_000


def word_counts(df: DataFrame, text_column: str, longest: int = LONGEST_WORD) -> DataFrame:
    """word, n: how often each word of the texts (cut at white space) occurs."""
    return (
        df.select(F.explode(words(F.col(text_column))).alias("word"))
        .where(F.length("word") <= longest)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


@dataclass(frozen=True)
class WordGraph:
    """Costs of the dictionary's words and of a character that starts none of them."""

    costs: dict[str, float]
    unknown: float
    longest: int

    @classmethod
    def fit(cls, counts: DataFrame, size: int = DICTIONARY_WORDS) -> WordGraph:
        """The ``size`` most frequent words (of equal counts the smaller ones) of a table of counts."""
        counts = counts.where("n > 0 and word <> ''").persist(StorageLevel.DISK_ONLY)
        try:
            # Tasks give no word that is rarer than the last one: how many words occur how often is a small table.
            least, held = 1, 0
            for n, words_of_it in sorted(counts.groupBy("n").count().collect(), reverse=True):
                least, held = n, held + words_of_it
                if held >= size:
                    break
            rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
        finally:
            counts.unpersist()
        total = sum(r["n"] for r in rows) or 1
        costs = {r["word"]: -math.log(r["n"] / total) for r in rows}
        return cls(costs, math.log(total) + 1, max(map(len, costs), default=1))

    def __getstate__(self):
        return {name: self.__dict__[name] for name in ("costs", "unknown", "longest")}

    @cached_property
    def _tree(self) -> dict:
        """character -> (cost of the word that ends here, or None; tree of the characters after it)."""
        tree: dict = {}
        for word, cost in self.costs.items():
            if not 0 < len(word) <= self.longest:
                continue
            node = tree
            for c in word[:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[word[-1]] = (cost, node.get(word[-1], (None, {}))[1])
        return tree

    @cached_property
    def _begun(self) -> dict:
        return {}

    def _beginning(self, head: str) -> tuple[list[tuple[int, float]], dict | None]:
        """Lengths and costs of the words that ``head`` begins with, and the tree of those that go on after it."""
        node, found = self._tree, []
        for size, c in enumerate(head, 1):
            if c not in node:
                node = None
                break
            cost, node = node[c]
            if cost is not None:
                found.append((size, cost))
        if len(self._begun) >= _REMEMBERED:
            self._begun.clear()
        self._begun[head] = found, node or None
        return self._begun[head]

    def cut(self, text: str) -> list[int]:
        """Ends of the words on the cheapest path; of equal paths that with the longest last words."""
        return self._cheapest(text, 0.0)[0]

    def _cheapest(self, text: str, before: float) -> tuple[list[int], float]:
        """Ends of the words on the cheapest path, and its cost if that of the path to the text is ``before``."""
        size, unknown, begun = len(text), self.unknown, self._begun
        best, back = [before, *[math.inf] * size], [0] * (size + 1)
        for at in range(size):
            # Words that end at a place come in the order of their starts, so the longest stays if costs are equal.
            here, head = best[at], text[at : at + _STRIDE]
            words, node = begun.get(head) or self._beginning(head)
            for length, cost in words:
                if here + cost < best[at + length]:
                    best[at + length], back[at + length] = here + cost, at
            if node:
                end = at + _STRIDE
                for c in text[end : at + self.longest]:
                    if c not in node:
                        break
                    cost, node = node[c]
                    end += 1
                    if cost is not None and here + cost < best[end]:
                        best[end], back[end] = here + cost, at
            if here + unknown < best[at + 1]:
                best[at + 1], back[at + 1] = here + unknown, at
        ends, end = [], size
        while end:
            ends.append(end)
            end = back[end]
        return ends[::-1], best[size]

    @cached_property
    def _table(self) -> tuple[Tree, np.ndarray, float]:
        """The tree in arrays, the costs of the words that end at its nodes, and the largest cost."""
        words = [word for word in self.costs if 0 < len(word) <= self.longest]
        tree = Tree(words)
        cost = np.full(len(tree.base), math.inf)
        cost[tree.ends] = [self.costs[word] for word in words]
        return tree, cost, max(self.unknown, np.abs(cost[cost < math.inf]).max(initial=0))

    def last_characters(self, codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Which code points are the last of a word, for many texts as :func:`cut` finds them one by one.

        Where no word goes on from one character to the next, all paths meet: the stretches between
        such places are cut side by side, first all their first characters, then the second ones. A
        path's cost is summed from its text's start, and the rounding of the sum may choose between
        equal paths. So a stretch whose cheapest path has a rival as cheap as rounding may make it is
        cut alone, from the cost before it, and so is a very long one.
        """
        tree, cost_of, largest = self._table
        n = len(codes)
        single, reach, arcs = np.full(n, self.unknown), np.arange(1, n + 1), []
        for length, at, node in tree.walk(codes):
            cost = cost_of.take(node)
            word = np.flatnonzero(cost < math.inf)
            at, cost = at.take(word), cost.take(word)
            if length == 1:
                single[at] = np.minimum(self.unknown, cost)
            else:
                arcs.append((length, at, cost))
                reach[at] = at + length
        # Stretches, and the place of each character in its own.
        begins = np.concatenate(([True], np.maximum.accumulate(reach)[:-1] == np.arange(1, n)))
        begin = np.flatnonzero(begins)
        size = np.diff(np.append(begin, n))
        place = np.arange(n) - np.repeat(begin, size)
        order = np.argsort(np.minimum(place, _STRETCH).astype(np.uint16), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        # Arcs in the order of the characters that they end with, and of their starts, the longest first.
        count = np.ones(n, np.int64)
        for length, start, _ in arcs:
            count[start + (length - 1)] += 1
        count = count[order]
        offset = np.concatenate(([0], np.cumsum(count)))
        free = offset[rank]
        source, cost = np.empty(offset[-1], np.int64), np.empty(offset[-1])
        origin = np.where(begins, n, np.concatenate(([n], rank[:-1])))
        for length, start, costs in reversed(arcs):
            end = start + (length - 1)
            slot = free.take(end)
            source[slot], cost[slot] = origin.take(start), costs
            free[end] = slot + 1
        source[offset[1:] - 1], cost[offset[1:] - 1] = origin[order], single[order]
        best, reached = np.empty(n + 1), np.empty(offset[-1])
        best[n] = 0.0
        edges = np.concatenate(([0], np.cumsum(np.bincount(np.minimum(place, _STRETCH))))).tolist()
        for a, b in zip(edges[:_STRETCH], edges[1:]):
            x, y = offset[a], offset[b]
            sums = best[source[x:y]] + cost[x:y]
            reached[x:y] = sums
            best[a:b] = np.minimum.reduceat(sums, offset[a:b] - x)
        done = edges[min(_STRETCH, len(edges) - 1)]
        reached[offset[done] :] = best[done:n] = math.inf
        longest = np.diff(np.append(texts, n)).max(initial=1)
        slack = longest * largest * min(int(size.max()), _STRETCH) * 2.0**-50
        near = reached <= np.repeat(best[:n] + slack, count)
        rivals = np.add.reduceat(near.view(np.int8), offset[:-1], dtype=np.int8)
        chosen = np.flatnonzero(near)[np.cumsum(rivals, dtype=np.int64) - rivals]
        back, paid, rivals = source.take(chosen), cost.take(chosen), rivals > 1
        # The paths, from the stretches' ends.
        last, alone = np.zeros(n, bool), size > _STRETCH
        of = np.flatnonzero(~alone)
        at = rank[begin[of] + size[of] - 1]
        while at.size:
            last[at] = True
            alone[of[rivals[at]]] = True
            at = back[at]
            on = np.flatnonzero(at < n)
            at, of = at[on], of[on]
        last, paid = last[rank], paid[rank]
        total, upto, text = 0.0, 0, -1
        owner = np.searchsorted(texts, begin, "right") - 1
        for i in np.flatnonzero(alone).tolist():
            if owner[i] != text:
                text, total = owner[i], 0.0
                upto = texts[text] + 1
            a, b = int(begin[i]), int(begin[i] + size[i])
            total = float(np.cumsum(np.append(total, paid[upto:a][last[upto:a]]))[-1])
            ends, total = self._cheapest(text_of(codes[a:b]), total)
            last[a:b] = False
            last[a - 1 + np.array(ends)] = True
            upto = b
        return last


def segmenter(graph: WordGraph, df: DataFrame):
    """A Column function: array of the words of a text without spaces; null texts have none."""
    held = df.sparkSession.sparkContext.broadcast(graph)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                ends = held.value.cut(text or "")
                out.append([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            yield pd.Series(out)

    return cut


def without_spaces(text: Column) -> Column:
    """The words of a text one after the other."""
    return F.array_join(words(text), "")


def word_lengths(text: Column) -> Column:
    """Characters of each word of a text with spaces, in order."""
    return F.transform(words(text), lambda w: F.length(w))


def piece_ends(names: list[str], ids: list[int], byte_ids: range) -> np.ndarray:
    """Ends of pieces in characters of the text (a character of several byte pieces ends with the last)."""
    if not ids or max(ids) < byte_ids.start or min(ids) >= byte_ids.stop:
        return np.cumsum([len(names[i]) for i in ids], dtype=np.int64)
    ends, at, pending = [], 0, b""
    for i in ids:
        if i in byte_ids:
            pending += bytes([i - byte_ids.start])
            try:
                at += len(pending.decode())
                pending = b""
            except UnicodeDecodeError:
                pass
        else:
            at += len(names[i])
        ends.append(at)
    return np.array(ends, np.int64)


def _together(texts: pa.Array, known: pa.Array) -> Iterator[tuple[list[str], pa.Array]]:
    """Texts (null ones are empty) and the lengths of their true words, about as many characters at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().cumsum()
    at = 0
    while at < len(texts):
        full = (sizes[at - 1] if at else 0) + _TOGETHER
        to = max(at + 1, int(np.searchsorted(sizes, full, "right")))
        yield [t or "" for t in texts.slice(at, to - at).to_pylist()], known.slice(at, to - at)
        at = to


def _gaps(graph: WordGraph, pieces: Pieces, texts: list[str], known: pa.Array) -> np.ndarray:
    """Rows of numbers, a column for each text: 1, words, pieces, words split, ends shared, true words, ends found."""
    codes, places, sizes = code_points(texts)
    words = graph.last_characters(codes, places)
    words[places] = False
    begun, ids = pieces.starts(codes, places)
    cuts = np.append(begun[1:], True)
    # The first piece has the space that stands before a text.
    cuts[places] = False
    upto = np.cumsum(cuts)
    marks = np.flatnonzero(words | (codes == SEPARATOR))
    ends = np.flatnonzero(words[marks])
    split = np.zeros(len(codes), bool)
    split[marks[ends]] = upto[marks[ends] - 1] > upto[marks[ends - 1]]
    n_known = pc.fill_null(pc.list_value_length(known), 0).to_numpy().astype(np.int64)
    # A word of unknown length puts all ends after it out of the text.
    lengths = pc.fill_null(pc.list_flatten(known), -(2**31)).to_numpy().astype(np.int64)
    after = np.concatenate(([0], np.cumsum(lengths)))
    first = np.cumsum(n_known) - n_known
    at = after[1:] - np.repeat(after[first], n_known)
    inside = (at > 0) & (at <= np.repeat(sizes, n_known))
    true = np.zeros(len(codes), bool)
    true[(np.repeat(places, n_known) + at)[inside]] = True
    sums = [np.add.reduceat(x, places, dtype=np.int64) for x in (words, ids, split, words & cuts, words & true)]
    sums[1][sizes == 0] = 0
    return np.stack([np.ones(len(texts), np.int64), *sums[:4], n_known, sums[4]])


def tokenization_gaps(
    df: DataFrame, text_column: str, by: list[str], graph: WordGraph, subwords: Subwords, truth: Column | None = None
) -> DataFrame:
    """Per group: words of texts without spaces, subword pieces, and how their boundaries agree.

    ``fragmentation_rate`` is the share of words that a piece ends inside of, ``shared_rate``
    the share of word ends that are piece ends, too. ``truth`` (array of the true words'
    lengths, see :func:`word_lengths`) adds precision and recall of the word ends found.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((graph, subwords.pieces))
    fields = "texts long, words long, pieces long, split long, shared long, true_words long, found long"
    source = df.select(*by, F.col(text_column).alias("_text"), (F.lit(None).cast("array<int>") if truth is None else truth).alias("_truth"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("_truth")
            made = [_gaps(*held.value, *part) for part in _together(batch.column("_text"), known)]
            if made:
                columns = [*map(batch.column, by), *(pa.array(x) for x in np.concatenate(made, axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*by).schema), fields])
    names = [f.split()[0] for f in fields.split(", ")]
    sums = source.mapInArrow(counted, schema).groupBy(*by).agg(*(F.sum(n).alias(n) for n in names))
    measured = sums.select(
        *by,
        "texts",
        "words",
        "pieces",
        ratio(F.col("pieces"), F.col("words")).alias("pieces_per_word"),
        ratio(F.col("split"), F.col("words")).alias("fragmentation_rate"),
        ratio(F.col("shared"), F.col("words")).alias("shared_rate"),
        ratio(F.col("found"), F.col("words")).alias("precision"),
        ratio(F.col("found"), F.col("true_words")).alias("recall"),
    )
    return measured if truth is not None else measured.drop("precision", "recall")
