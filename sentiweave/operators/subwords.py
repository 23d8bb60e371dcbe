"""Subword pieces of a public vocabulary: ids, counts, truncation, fragmentation of words.

The vocabulary (a SentencePiece model file, given by its path) is read on the driver and goes
to tasks as a table of pieces with ids and scores, whose size doesn't depend on the corpus.
Texts are encoded where they lie, without a shuffle: a text is cut into chunks at its spaces,
which no piece crosses, and a chunk into parts between two characters that stand side by side
in no piece; each task encodes a chunk and a part once and remembers them.

Encoding a part starts from its characters and joins the two neighbours whose joint piece has
the highest score, the leftmost of equal ones, until no two neighbours make a piece.
Characters without a piece become their UTF-8 bytes, which all have one.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.functions.text import Tokenizer
from sentiweave.operators.pairtable import SEPARATOR, PairTable, Tree, text_of

SPACE = "▁"
#: Chunks (and as many parts) after which a task forgets those unused since as many more, and the longest that it remembers.
REMEMBERED = 150_000
REMEMBERED_LENGTH = 64
#: Texts that are Python strings at a time.
_ROWS = 64
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]*")
#: Parts of at most so many characters are joined side by side, those of like length together.
_WIDTHS = (2, 4, 8, 16, 32, 64, 128)
#: Parts of more characters are cut again before that.
_LONG_PART = 16
_NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    """Path of the installed public SentencePiece model with 32,000 pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """piece -> (id, score) of the pieces that merges may make, and the ids of bytes."""

    table: dict[str, tuple[int, float]]
    byte_ids: list[int]
    names: list[str]
    begin: int
    end: int

    def __post_init__(self):
        places = {score: n for n, score in enumerate(sorted({score for _, score in self.table.values()}, reverse=True))}
        #: Place of a piece's score (the highest is 0), and of two characters that stand side by side in a piece.
        self.places = {name: places[score] for name, (_, score) in self.table.items()}
        pairs = {name[i : i + 2] for name in self.table for i in range(len(name) - 1)}
        self.pairs = {pair: self.places.get(pair, len(self.places)) for pair in pairs}
        self.raw = [name.encode() for name in self.names]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        for i in (self.begin, self.end):
            if i >= 0:
                self.raw[i] = b""
        self._forget()

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        special = {i for i in range(len(names)) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        byte_ids = [i for i in range(len(names)) if model.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError(f"{path} has no piece for each byte")
        table = {n: (i, model.get_score(i)) for i, n in enumerate(names) if i not in special and not model.is_byte(i)}
        if any(SPACE in name.lstrip(SPACE) for name in table):
            raise ValueError(f"{path} has pieces that go on past a space")
        return cls(table, byte_ids, names, model.bos_id(), model.eos_id())

    def _forget(self) -> None:
        self.seen, self.seen_parts = _Remembered(self.chunk), _Remembered(self._part)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith(("seen", "_joints"))}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def chunk(self, text: str) -> bytes:
        """Packed ids of a text that is a single chunk."""
        edges = [i for i, pair in enumerate(map(str.__add__, text, text[1:]), 1) if pair not in self.pairs]
        if not edges:
            return self.seen_parts[text]
        return b"".join([self.seen_parts[text[a:b]] for a, b in zip([0, *edges], [*edges, len(text)], strict=True)])

    def _part(self, text: str) -> bytes:
        ids = array("i")
        for piece in self._joined(text) if len(text) <= REMEMBERED_LENGTH else self._joined_long(text):
            found = self.table.get(piece)
            if found:
                ids.append(found[0])
            else:
                ids.extend(self.byte_ids[b] for b in piece.encode())
        return ids.tobytes()

    def _joined(self, text: str) -> list[str]:
        """Pieces of a short part."""
        place, none = self.places.get, len(self.places)
        parts, waiting = list(text), [*map(self.pairs.__getitem__, map(str.__add__, text, text[1:]))]
        while waiting and (first := min(waiting)) < none:
            i = waiting.index(first)
            joint = parts[i] = parts[i] + parts.pop(i + 1)
            del waiting[i]
            if i < len(waiting):
                waiting[i] = place(joint + parts[i + 1], none)
            if i:
                waiting[i - 1] = place(parts[i - 1] + joint, none)
        return parts

    def _joined_long(self, text: str) -> list[str]:
        """Pieces of a part of any length."""
        parts: list[str | None] = list(text)
        before = list(range(-1, len(parts) - 1))
        after = [*range(1, len(parts)), -1]
        waiting: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0:
                joint = parts[left] + parts[right]
                if joint in self.table:
                    heapq.heappush(waiting, (-self.table[joint][1], left, joint))

        for i in range(len(parts) - 1):
            offer(i)
        while waiting:
            _, left, joint = heapq.heappop(waiting)
            if parts[left] is None or (right := after[left]) < 0 or parts[left] + parts[right] != joint:
                continue  # one of the two has been joined with another since
            parts[left], parts[right] = joint, None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [p for p in parts if p]

    @cached_property
    def _joints(self) -> tuple[np.ndarray, PairTable, np.ndarray, int]:
        """Numbers of characters; of the joint of two numbers (-1 if only longer pieces have both); places; how many are pieces.

        Pieces have the numbers 1 and up, then come the characters that only longer pieces have.
        """
        numbers = {name: n for n, name in enumerate(self.table, 1)}
        for c in sorted({c for name in self.table for c in name} - numbers.keys()):
            numbers[c] = len(numbers) + 1
        first = np.zeros(SEPARATOR + 1, np.int32)
        for name, n in numbers.items():
            if len(name) == 1:
                first[ord(name)] = n
        joints = {(numbers[pair[0]], numbers[pair[1]]): -1 for pair in self.pairs}
        for name in self.table:
            for cut in range(1, len(name)):
                left, right = numbers.get(name[:cut]), numbers.get(name[cut:])
                if left and right:
                    joints[left, right] = numbers[name]
        return first, PairTable(joints), np.array([0, *map(self.places.__getitem__, self.table)], np.int32), len(self.table)

    @cached_property
    def _joints_tree(self) -> tuple[Tree, np.ndarray]:
        """The pieces of two and more characters as a tree, and which of its nodes are pieces."""
        tree = Tree([name for name in self.table if len(name) > 1])
        ends = np.zeros(len(tree.base), bool)
        ends[tree.ends] = True
        return tree, ends

    def starts(self, codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start in the code points of texts, and how many ids each has that starts at a place.

        ``texts`` are the places where texts start, each with a character that the space before it takes.
        Bytes of a character without a piece start and end with it.
        """
        first, joints, place, n_pieces = self._joints
        codes = codes.copy()
        codes[texts] = ord(SPACE)
        codes[codes == ord(" ")] = ord(SPACE)
        numbers, joint = first[codes], np.zeros(len(codes), np.int32)
        joint[:-1] = joints.find(numbers[:-1], numbers[1:])
        joint[texts[1:] - 1] = 0
        begin, size = _runs(joint)
        # Long parts are cut again, where no whole piece goes on from one character to the next.
        at = np.flatnonzero(np.repeat(size > _LONG_PART, size))
        if at.size:
            tree, ends = self._joints_tree
            reach = np.arange(1, len(codes) + 1)
            for length, on, node in tree.walk(codes, at):
                on = on[ends[node]]
                reach[on] = on + length
            apart = at[np.maximum.accumulate(reach)[at] == at + 1]
            joint[apart] = 0
            begin, size = _runs(joint)
        started = np.ones(len(codes), bool)
        for before, width in zip((1, *_WIDTHS), _WIDTHS):
            fit = np.flatnonzero((size > before) & (size <= width))
            if fit.size:
                self._join(begin[fit], size[fit], width, numbers, joint, started)
        for at, n in zip(*(x[size > _WIDTHS[-1]].tolist() for x in (begin, size))):
            pieces = self._joined_long(text_of(codes[at : at + n]))
            started[at : at + n] = False
            places = at + np.cumsum([0, *map(len, pieces[:-1])])
            started[places] = True
            # Only whether it is a piece is asked for below; any joint is one.
            numbers[places[np.array([len(p) > 1 for p in pieces])]] = 1
        utf8 = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        ids = np.where(started, np.where((numbers > 0) & (numbers <= n_pieces), 1, utf8), 0)
        return started, ids

    def _join(self, begin, size, width, numbers, joint, started) -> None:
        """Joins the two neighbours of the best joint in each part at a time, until none has a joint."""
        _, joints, place, _ = self._joints
        row = np.arange(width + 1, dtype=np.int32)[:, None]
        at = np.minimum(begin + row, len(numbers) - 1)
        # Rows are characters and columns parts; the last row is no character's.
        here = np.where(row < size, numbers[at], 0)
        made = np.where(row < size - 1, joint[at], 0)
        key = np.where(made > 0, place[np.maximum(made, 0)] * width + row, _NONE).astype(np.int32)
        after = np.broadcast_to(row + 1, here.shape).astype(np.int32)
        prior = np.broadcast_to(row - 1, here.shape).astype(np.int32)
        here, made, key, after, prior = map(np.ascontiguousarray, (here, made, key, after, prior))
        while True:
            best = key.min(axis=0)
            live = np.flatnonzero(best < _NONE)
            if not live.size:
                return
            n = key.shape[1]
            if 2 * live.size < n:
                begin, best = begin[live], best[live]
                here, made, key, after, prior = (x.take(live, axis=1) for x in (here, made, key, after, prior))
                n, live = live.size, np.arange(live.size)
            f_here, f_made, f_key, f_after, f_prior = (x.reshape(-1) for x in (here, made, key, after, prior))
            j = best[live] & (width - 1)
            left = j.astype(np.int64) * n + live
            gone = f_after[left]
            right = gone.astype(np.int64) * n + live
            then = f_after[right]
            numbers[begin[live] + j] = f_here[left] = f_made[left]
            started[begin[live] + gone] = False
            f_key[right] = _NONE
            f_after[left] = then
            next_ = then.astype(np.int64) * n + live
            before = f_prior[left]
            # Before the first character is the last row, too.
            before[before < 0] = width
            f_prior[next_] = j
            a = np.concatenate((left, before.astype(np.int64) * n + live))
            found = joints.find(f_here[a], f_here[np.concatenate((next_, left))])
            f_made[a] = found
            f_key[a] = np.where(found > 0, place[np.maximum(found, 0)] * width + np.concatenate((j, before)), _NONE)

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers; empty for an empty one."""
        return b"".join(map(self.seen.__getitem__, _CHUNK.findall(SPACE + text.replace(" ", SPACE)))) if text else b""

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; empty for an empty one."""
        return array("i", self.packed(text)).tolist()

    def first(self, text: str, limit: int) -> list[int]:
        """The first ``limit`` ids of a text; what comes after them isn't encoded."""
        ids = array("i")
        for chunk in _CHUNK.finditer(SPACE + text.replace(" ", SPACE)) if text else ():
            if len(ids) >= limit:
                break
            ids.frombytes(self.seen[chunk[0]])
        return ids[:limit].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode(errors="replace").replace(SPACE, " ").removeprefix(" ")


def _runs(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of places that are joined, each with the next."""
    begin = np.concatenate(([0], np.flatnonzero(joint[:-1] == 0) + 1))
    return begin, np.diff(np.append(begin, len(joint)))


class _Remembered(dict):
    """Makes what it hasn't seen; what hasn't been used since it was full is forgotten when it is full again."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def _strings(texts: pa.Array) -> Iterator[str]:
    """The texts, some at a time; null ones are empty."""
    for start in range(0, len(texts), _ROWS):
        for text in texts.slice(start, _ROWS).to_pylist():
            yield text or ""


def _lists(lists: pa.Array) -> Iterator[list[int] | None]:
    sizes = lists.value_lengths().to_pylist()
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), 0
    for size in sizes:
        yield None if size is None else flat[at : at + size].tolist()
        at += size or 0


class Subwords:
    """Column functions of a vocabulary; null texts count as empty ones."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.pieces = Pieces.read(path or default_vocabulary())
        held = spark.sparkContext.broadcast(self.pieces)

        @F.arrow_udf("array<int>")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                flat, ends = array("i"), array("i", [0])
                for text in _strings(texts):
                    flat.frombytes(held.value.packed(text))
                    ends.append(len(flat))
                yield pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(flat)))

        @F.arrow_udf("int")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([len(held.value.packed(t)) // 4 for t in _strings(texts)], pa.int32())

        @F.arrow_udf("string")
        def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                yield pa.array((None if x is None else held.value.decode(x) for x in _lists(lists)), pa.string())

        @F.arrow_udf("string")
        def first(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, limits in batches:
                pairs = zip(_strings(texts), limits.to_pylist(), strict=True)
                yield pa.array((held.value.decode(held.value.first(t, n)) for t, n in pairs), pa.string())

        self._ids, self._count, self._text_of, self._first, self._held = ids, count, text_of, first, held

    def ids(self, text: Column) -> Column:
        """Ids without special tokens."""
        return self._ids(text)

    def text_of(self, ids: Column) -> Column:
        return self._text_of(ids)

    def count(self, text: Column) -> Column:
        """Number of ids; the ids themselves stay in the task."""
        return self._count(text)

    def first(self, text: Column, limit: int) -> Column:
        """The text of the first ``limit`` ids; neither the others nor their text leave the task."""
        return self._first(text, F.lit(limit))

    def tokenizer(self) -> Tokenizer:
        """For counts with a first and a last token, truncation and fragmentation."""
        return Tokenizer(split=self.ids, join=self.text_of, special_tokens=2, count=self.count, first=self.first)

    def inputs(self, text: Column, limit: int) -> Column:
        """Model input: first token, at most ``limit`` - 2 ids, last token."""
        ids = F.slice(self.ids(text), 1, limit - 2)
        return F.concat(F.array(F.lit(self.pieces.begin)), ids, F.array(F.lit(self.pieces.end)))


def subword_inputs(df: DataFrame, text_column: str, subwords: Subwords, limit: int) -> DataFrame:
    """``df`` with input_ids, cut to ``limit``, and attention_mask of the whole batch's rows."""
    rows = df.withColumn("input_ids", subwords.inputs(F.col(text_column), limit))
    return rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
