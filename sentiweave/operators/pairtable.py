"""Pairs of numbers, and strings character by character, looked up many at a time in arrays."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np

#: One more than the last code point: stands between texts and is in no word or piece.
SEPARATOR = 0x110000
_FREE = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)
_ONE = np.uint64(1)


class PairTable:
    """(left, right) -> number; 0 where there is none. A hash table in arrays, a quarter or less of it in use."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.uint64(2**bits - 1)
        self.keys, self.values = np.full(2**bits, _FREE), np.zeros(2**bits, np.int32)
        both = np.array(list(pairs), np.uint64).reshape(-1, 2)
        keys, values = both[:, 0] << _HALF | both[:, 1], np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = keys * _MIX >> self.shift
        while keys.size:
            free = np.flatnonzero(self.keys[slots] == _FREE)
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = (np.delete(x, put) for x in (keys, values, slots))
            slots = slots + _ONE & self.last

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64)
        keys <<= _HALF
        keys |= right.astype(np.uint64)
        slots = keys * _MIX
        slots >>= self.shift
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], 0)
        rest = np.flatnonzero((held != keys) & (held != _FREE))
        keys, slots = keys[rest], slots[rest]
        while rest.size:
            slots = slots + _ONE & self.last
            held = self.keys[slots]
            same = held == keys
            out[rest[same]] = self.values[slots[same]]
            on = np.flatnonzero(~same & (held != _FREE))
            rest, keys, slots = rest[on], keys[on], slots[on]
        return out


class Tree:
    """Strings as a tree of characters. A node is a place: its child for a class of characters is the place
    ``base[node] + class``, if ``check`` has the node there."""

    def __init__(self, strings: list[str]):
        nodes: dict[tuple[int, int], int] = {}
        ends = []
        for string in strings:
            node = 0
            for c in string:
                node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
            ends.append(node)
        self.longest = max(map(len, strings), default=0)
        often = Counter(c for _, c in nodes).most_common()
        self.classes, self.first = np.zeros(SEPARATOR + 1, np.int32), np.zeros(SEPARATOR + 1, np.int32)
        self.classes[[c for c, _ in often]] = np.arange(1, len(often) + 1)
        children = defaultdict(list)
        for (node, c), child in nodes.items():
            children[node].append((int(self.classes[c]), child))
        # Nodes of many children take places first; those of one take what is free.
        room, pick = len(often) + 1, np.random.default_rng(0)
        used, place = np.zeros(4 * len(nodes) + 2 * room, bool), np.zeros(len(nodes) + 1, np.int64)
        used[0], base_of = True, np.zeros(len(nodes) + 1, np.int64)
        for node in sorted((n for n in children if len(children[n]) > 1), key=lambda n: -len(children[n])):
            classes = np.array([c for c, _ in children[node]])
            for _ in range(50):
                tried = pick.integers(0, len(used) - room, 32)
                free = np.flatnonzero(~used[tried[:, None] + classes].any(axis=1))
                if free.size:
                    base_of[node] = tried[free[0]]
                    break
            else:
                base_of[node] = len(used)
                used = np.concatenate((used, np.zeros(2 * room, bool)))
            used[base_of[node] + classes] = True
            place[[child for _, child in children[node]]] = base_of[node] + classes
        single = [n for n in children if len(children[n]) == 1]
        if single:
            classes, only = np.array([children[n][0] for n in single]).T
            free = np.flatnonzero(~used[room:])[: len(single)] + room
            base_of[single], place[only] = free - classes, free
        self.base, self.check = np.zeros(len(used) + room, np.int32), np.full(len(used) + room, -1, np.int32)
        self.base[place[1:]] = base_of[1:]
        for (node, c), child in nodes.items():
            if node:
                self.check[place[child]] = place[node]
            else:
                self.first[c] = place[child]
        #: Place of each of the strings.
        self.ends = place[ends]

    def walk(self, codes: np.ndarray, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """length, starts, nodes: where the code points (of the starts ``at``) go on with so many characters of a string."""
        classes = np.concatenate((self.classes[codes], np.zeros(self.longest, np.int32)))
        node = self.first[codes if at is None else codes[at]]
        on = np.flatnonzero(node)
        at, node = on if at is None else at[on], node[on]
        for length in range(1, self.longest + 1):
            if not at.size:
                return
            yield length, at, node
            to = self.base.take(node)
            to += classes[length:].take(at)
            on = np.flatnonzero(self.check.take(to) == node)
            at, node = at.take(on), to.take(on)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts with a separator before each, the separators' places, and the texts' lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer(("\0" + "\0".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    places = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    codes[places] = SEPARATOR
    return codes, places, sizes


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
