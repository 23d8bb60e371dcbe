"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state with an arc for each byte, so that
every split of a word is accepted, and takes one gadget for each merge ``u v -> uv`` in
the order of the merges:

1. behind ``u`` the arc ``v`` is cut (the two would have been merged), and
2. wherever ``u`` could start, an arc ``uv`` starts as well; its target has the arcs that
   ``v``'s target had before the cut.

What is left accepts, for every word, exactly one path: the sequence that the merges
yield. All paths into a state end with the same token, so a state is named by it. A gadget
copies a row (the arcs behind a token) and a column (the states that have the arc) of the
transition table; :class:`MergeAutomaton` keeps the copies as references to their origin
and the gadget's number, and fills table entries the first time a word asks for them.

Since each prefix of a word is a word, it too has exactly one path, so there is one state
at most for each byte position, and reading a word takes linear time.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, plus, share, table

#: Words that a Python worker remembers the codes of; when full it starts anew.
REMEMBERED_WORDS = 100_000
#: Entries of the transition table that a worker keeps; when full it starts anew.
TABLE_ENTRIES = 400_000

START = -1


def byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable ones stand for themselves,
    the others follow from U+0100 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Letters and numbers of Unicode 16, which the tokenizers library knows and
#: Python's own table (15.1) doesn't.
UNICODE_16 = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
        (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
        (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
        (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
        (0x1E5F0, 0x1E5F0),
    ),
    "N": (
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
        (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
    ),
}


def _ranges(first_letter: str, below: int) -> str:
    """Inside of a character class for the general category that starts with the letter."""
    out = [f"\\U{a:08x}-\\U{b:08x}" for a, b in UNICODE_16[first_letter] if b < below]
    start = None
    for code in range(below + 1):
        inside = code < below and unicodedata.category(chr(code))[0] == first_letter
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def word_pattern(below: int = sys.maxunicode + 1) -> str:
    """The byte-level split into contractions, letters, digits, other signs and space, for
    texts of characters ``below``: small classes match many times faster than whole ones."""
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    if below <= 0x100:
        space = "\\t-\\r \\x85\\xa0"
    letters, digits = _ranges("L", below), _ranges("N", below)
    return (
        f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digits}]+| ?[^{space}{letters}{digits}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def _width(text: str) -> int:
    """0: all characters below U+0100, 1: below U+10000, 2: others too."""
    try:
        text.encode("latin-1")
        return 0
    except UnicodeEncodeError:
        return int(len(text.encode("utf-16-le")) > 2 * len(text)) + 1


class MergeAutomaton:
    """The automaton of a list of merges over byte tokens; see the module's text."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """labels: id -> bytes. merges: (left id, right id, merged id), first merge first."""
        self.label = labels
        self.cut: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.row_of: dict[int, int] = {}  # token -> token whose row it was copied from
        self.column_of: dict[int, int] = {}  # token -> token whose column it was copied from
        for number, (left, right, merged) in enumerate(merges):
            self._gadget(number, left, right, merged)
        self.rows: dict[int, dict[int, bool]] = {}
        self.entries = 0
        self.arcs: dict[bytes, int] = {}  # label or start of labels -> token or START
        for token, label in labels.items():
            for end in range(1, len(label)):
                self.arcs.setdefault(label[:end], START)
            self.arcs[label] = token
        self.shorter = dict.fromkeys(labels, START)  # longest other token that it starts with
        for token, label in labels.items():
            for end in range(len(label) - 1, 0, -1):
                if self.arcs[label[:end]] != START:
                    self.shorter[token] = self.arcs[label[:end]]
                    break

    def _gadget(self, number: int, left: int, right: int, merged: int) -> None:
        if merged in self.born:
            raise ValueError(f"two merges yield token {merged}")
        self.cut[left, right] = number
        self.born[merged] = number
        self.row_of[merged] = right
        self.column_of[merged] = left

    def follows(self, token: int, other: int) -> bool:
        """Has the state behind ``token`` an arc ``other``? Goes back through the copies."""
        before = sys.maxsize  # gadgets with a smaller number count
        while True:
            if self.cut.get((token, other), sys.maxsize) < before:
                return False
            row, column = self.born.get(token, -1), self.born.get(other, -1)
            if row < 0 and column < 0:
                return True
            if row >= column:  # the row was copied before its gadget's cut
                before, token = min(before, row), self.row_of[token]
            else:  # the column after it
                before, other = min(before, column + 1), self.column_of[other]

    def longest(self, word: bytes, begin: int) -> int:
        """The longest token that the bytes from ``begin`` on start with."""
        found, arcs = START, self.arcs
        for end in range(begin + 1, len(word) + 1):
            token = arcs.get(word[begin:end])
            if token is None:
                break
            if token != START:
                found = token
        return found

    def read(self, word: bytes) -> list[int]:
        """The tokens on the one path that spells ``word``.

        Tries arcs from the longest on. A position from which the end can't be reached is
        marked and not entered again, which makes the time linear in the word's length.
        """
        if self.entries > TABLE_ENTRIES:
            self.rows, self.entries = {}, 0
        size, label, shorter, rows = len(word), self.label, self.shorter, self.rows
        dead = bytearray(size + 1)
        path: list[int] = []
        at, state, token = 0, START, self.longest(word, 0)
        while at < size:
            while token != START:
                end = at + len(label[token])
                if not dead[end]:
                    row = rows.get(state)
                    if row is None:
                        row = rows[state] = {}
                    open_ = row.get(token)
                    if open_ is None:
                        open_ = row[token] = state == START or self.follows(state, token)
                        self.entries += 1
                    if open_:
                        break
                token = shorter[token]
            else:
                dead[at] = 1
                token = path.pop()
                at -= len(label[token])
                state, token = path[-1] if path else START, shorter[token]
                continue
            path.append(token)
            at, state, token = end, token, self.longest(word, end)
        return path


class ByteBpe:
    """A vocabulary file's word split, added tokens and automaton; travels by broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, split = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"]:
            raise ValueError("a byte-level BPE vocabulary without prefix space is needed")
        if data["normalizer"] or not split["use_regex"]:
            raise ValueError("normalizers and other word splits are not supported")
        added = data["added_tokens"] or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        vocab, byte_of = model["vocab"], byte_characters()
        self.added = {t["content"]: t["id"] for t in added}
        self.added_label = {t["id"]: t["content"].encode() for t in added}
        self.labels = {
            i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.added
        }
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self._labels = None
        self.patterns = [word_pattern(below) for below in (0x100, 0x10000, sys.maxunicode + 1)]
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None, "_labels": None}

    def ready(self):
        """Built once in each Python worker that encodes: split, added tokens, automaton, memory."""
        if self._ready is None:
            automaton = MergeAutomaton(self.labels, self.merges)
            longest_first = sorted(self.added, key=len, reverse=True)
            added = re.compile("|".join(map(re.escape, longest_first))) if self.added else None
            split = [re.compile(p).findall for p in self.patterns]
            self._ready = split, added, automaton, {}
        return self._ready

    def _codes(self, text: str) -> list[bytes]:
        split, _, automaton, memory = self.ready()
        words = split[_width(text)](text)
        try:
            return [memory[w] for w in words]
        except KeyError:
            pass
        out = []
        for word in words:
            code = memory.get(word)
            if code is None:
                ids = array("I", automaton.read(word.encode()))
                if sys.byteorder == "big":
                    ids.byteswap()
                code = ids.tobytes()
                if len(memory) >= REMEMBERED_WORDS:
                    memory.clear()
                if len(word) <= 64:
                    memory[word] = code
            out.append(code)
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        added = self.ready()[1]
        if added is None or not added.search(text):
            return b"".join(self._codes(text))
        parts, start = [], 0
        for match in added.finditer(text):
            parts += self._codes(text[start : match.start()])
            parts.append(self.added[match[0]].to_bytes(4, "little"))
            start = match.end()
        return b"".join(parts + self._codes(text[start:]))

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after the other."""
        if self._labels is None:
            self._labels = [b""] * (max([*self.labels, *self.added_label], default=-1) + 1)
            for token, label in (self.labels | self.added_label).items():
                self._labels[token] = label
        labels = self._labels
        codes = array("I", ids)
        if sys.byteorder == "big":
            codes.byteswap()
        return b"".join([labels[i] for i in codes]).decode("utf-8", "replace")


def encode(df: DataFrame, text_column: str, path: str, output: str = "token_ids") -> DataFrame:
    """``df`` with the ids of a text column's tokens in a binary column.

    ``output`` holds unsigned 32-bit integers, little-endian. A null text counts as empty
    and has no ids. Repeated rows stay repeated rows; other columns are untouched, and an
    existing column ``output`` is replaced.
    """
    return _texts_to(df, text_column, output, "binary", ByteBpe(path), "encode")


def decode(df: DataFrame, ids_column: str, path: str, output: str = "decoded") -> DataFrame:
    """``df`` with the text of an id column of :func:`encode`; null ids give an empty text."""
    return _texts_to(df, ids_column, output, "string", ByteBpe(path), "decode")


def _texts_to(
    df: DataFrame, column: str, output: str, kind: str, tokenizer: ByteBpe, method: str
) -> DataFrame:
    shared = share(df.sparkSession, tokenizer)
    kept = [c for c in df.columns if c != output]
    schema = plus(df.select(*(F.col(f"`{c}`") for c in kept)).schema, f"`{output}` {kind}")
    empty, arrow_type = (b"", pa.binary()) if method == "decode" else ("", pa.string())
    out_type = pa.binary() if kind == "binary" else pa.string()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        run = getattr(shared(), method)
        values = batch.column(batch.schema.get_field_index(column)).cast(arrow_type)
        made = pa.array([run(empty if v is None else v) for v in values.to_pylist()], out_type)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in kept), made], [*kept, output]
        )

    return arrow_map(df, schema, rows)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding again."""
    coded = encode(docs.select("doc_id", "text"), "text", path, "token_ids")
    both = decode(coded.select("doc_id", "token_ids"), "token_ids", path, "decoded")
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("token_ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; used where no path is given."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())
