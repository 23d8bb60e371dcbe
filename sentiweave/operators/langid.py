"""Language identification from character-trigram profiles.

Profiles are learned with one grouped count over a labelled corpus: tasks count trigrams as
numbers, text by text, and only counts are exploded and shuffled. A profile table of
moderate size travels to every task once and each text is scored where it lies, so no
text and no trigram is shuffled; :func:`detect_by_join` gives the same languages with a
table of any size. A text without a known trigram has no language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiweave.functions.text import WS, is_blank

GRAM = 3
# Scores are integers (log-probability * SCALE), so they do not depend on addition order.
SCALE = 1_000
_WINDOW = 1 << 20
#: Counts that a task holds before it gives them on, and rows of an Arrow batch of them.
_HELD_COUNTS = 1 << 20
_OUT_ROWS = 1 << 16
#: Places of a table of all trigrams of the profiles' characters, if there are no more of them.
_DENSE = 1 << 22
_SALTS = 64


def gram_text(text: Column) -> Column:
    """Lower-cased text with single spaces, padded so that word edges form trigrams."""
    flat = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{WS}+", " "))
    return F.concat(F.lit(" "), flat, F.lit(" "))


def grams(text: Column) -> Column:
    """Array of all trigrams: overlapping matches, none of which starts inside a pair."""
    every = r"(?s)(?![\x{dc00}-\x{dfff}])(?=(.{3}))"
    return F.regexp_extract_all(gram_text(text), F.lit(every), F.lit(1))


def language_profiles(
    df: DataFrame, text: str, lang: str, grams_per_language: int | None = None
) -> DataFrame:
    """``(lang, gram, n, weight)``: trigrams with integer log weights, all or the most frequent.

    Tasks count first. The ranking runs first within salted parts of
    each language, then over what those parts kept, so no task sorts all trigrams of
    a language.
    """
    rows = df.where(~is_blank(F.col(text)) & F.col(lang).isNotNull())
    padded = rows.select(F.col(lang).alias("lang"), gram_text(F.col(text)).alias("_padded"))
    schema = f"lang {padded.schema['lang'].dataType.simpleString()}, gram string, n long"
    counts = (
        padded.mapInArrow(_gram_counts, schema)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("_salt", F.pmod(F.xxhash64("gram"), F.lit(_SALTS)))
    )
    kept = counts
    for part in (["lang", "_salt"], ["lang"]) if grams_per_language is not None else ():
        frequent = Window.partitionBy(*part).orderBy(F.desc("n"), "gram")
        kept = (
            kept.withColumn("_place", F.row_number().over(frequent))
            .where(F.col("_place") <= grams_per_language)
            .drop("_place")
        )
    # One row per language, joined back: no task gets all trigrams of a language.
    totals = kept.groupBy("lang").agg(F.sum("n").cast("double").alias("_total"))
    weight = F.rint(F.log(F.col("n").cast("double") / F.col("_total")) * SCALE).cast("long")
    return kept.join(totals, "lang").select("lang", "gram", "n", weight.alias("weight"))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n of a task's padded texts; a gram comes once, or once for each ``_HELD_COUNTS`` of them."""
    held: dict = {}
    for batch in batches:
        kind = batch.schema.field(0).type
        langs = batch.column(0).dictionary_encode()
        names, owner = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for place, name in enumerate(names):
            parts = [held[name]] if name in held else []
            parts += map(_counted, _groups(batch.column(1), np.flatnonzero(owner == place)))
            held[name] = _added(parts)
        if sum(len(codes) for codes, _ in held.values()) >= _HELD_COUNTS:
            yield from _count_rows(held, kind)
            held = {}
    if held:
        yield from _count_rows(held, kind)


def _groups(texts: pa.Array, places: np.ndarray) -> Iterator[list[str]]:
    """Texts at the places as windows, of about ``_WINDOW`` characters together."""
    group, size = [], 0
    for i in places.tolist():
        for part in _windows(texts[i].as_py()):
            group.append(part)
            size += len(part)
            if size >= _WINDOW:
                yield group
                group, size = [], 0
    if group:
        yield group


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after the other, and places where a trigram of one of them begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    begins = np.ones(max(0, len(points) - GRAM + 1), bool)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    for back in range(1, GRAM):
        last = ends - back
        begins[last[(last >= 0) & (last < len(begins))]] = False
    return points, np.flatnonzero(begins)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points, begins = _points(texts)
    if not len(begins):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(_codes(points)[begins], return_counts=True)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, place, np.concatenate([n for _, n in parts]))
    return codes, sums


def _count_rows(held: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    mask = (1 << 21) - 1
    for name, (codes, sums) in held.items():
        for start in range(0, len(codes), _OUT_ROWS):
            some, n = codes[start : start + _OUT_ROWS], sums[start : start + _OUT_ROWS]
            points = np.stack([some >> 42, some >> 21 & mask, some & mask], axis=1).astype("<u4")
            joint = points.tobytes().decode("utf-32-le")
            grams = [joint[i : i + GRAM] for i in range(0, len(joint), GRAM)]
            columns = [pa.array([name] * len(some), kind), pa.array(grams, pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


@dataclass(frozen=True)
class LanguageProfiles:
    """Profiles as arrays: sorted trigram codes and one weight column per language."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    missing: int

    @classmethod
    def fit(cls, df: DataFrame, text: str, lang: str, **options: int | None) -> LanguageProfiles:
        return cls.from_table(language_profiles(df, text, lang, **options))

    @classmethod
    def from_table(cls, profiles: DataFrame) -> LanguageProfiles:
        """Read a profile table: languages x trigrams rows, which the caller has chosen."""
        rows = profiles.select("lang", "gram", "weight").toPandas()
        if rows.empty:
            raise ValueError("No profiles: the corpus has no labelled text")
        table = rows.pivot(index="gram", columns="lang", values="weight")
        codes = np.array([_codes(np.array([ord(c) for c in gram]))[0] for gram in table.index])
        order = np.argsort(codes)
        # A trigram outside a profile weighs less than the rarest one in any profile.
        missing = int(rows["weight"].min()) - SCALE
        filled = table.fillna(missing).to_numpy().astype(np.int64)
        return cls(tuple(table.columns), codes[order], filled[order], missing)

    @cached_property
    def _dense(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Number of each character (0: in no profile), and place of three numbers' trigram (-1: none)."""
        mask = (1 << 21) - 1
        points = np.stack([self.codes >> 42, self.codes >> 21 & mask, self.codes & mask])
        chars, numbers = np.unique(points, return_inverse=True)
        size = len(chars) + 1
        if size**GRAM > _DENSE:
            return None
        number = np.zeros(0x110000, np.int32)
        number[chars] = np.arange(1, size)
        one, two, three = numbers.reshape(points.shape) + 1
        places = np.full(size**GRAM, -1, np.int32)
        places[(one * size + two) * size + three] = np.arange(len(self.codes))
        return number, places

    def _places(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Place in ``codes`` of the trigrams that begin there, -1 for others."""
        if self._dense is None:
            codes = _codes(points)[begins]
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            return np.where(self.codes[place] == codes, place, -1)
        number, places = self._dense
        size = round(len(places) ** (1 / GRAM))
        numbers = number[points]
        return places[((numbers[:-2] * size + numbers[1:-1]) * size + numbers[2:])[begins]]

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight per text and language, known trigrams and all trigrams per text.

        All texts are looked up at once; trigrams that cross two texts count for none.
        """
        points, begins = _points(texts)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))[begins]
        place = self._places(points, begins) if len(begins) else np.empty(0, np.int64)
        known = place >= 0
        count = np.bincount(owner, minlength=len(texts))
        hits = np.bincount(owner[known], minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        if known.any():
            mine = owner[known]
            first = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1))
            total[mine[first]] = np.add.reduceat(self.weights[place[known]], first, axis=0)
        return total + ((count - hits) * self.missing)[:, None], hits, count

    def score(self, padded: str) -> np.ndarray:
        """Total weight of a padded text per language."""
        return self._sums(_windows(padded))[0].sum(axis=0)

    def best(self, texts: list[str], min_known: float) -> list[str | None]:
        """The language of each padded text; None where too few trigrams are known."""
        out: list[str | None] = []
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= _WINDOW or i == len(texts) - 1:
                # Long texts are cut into windows that overlap by two, to bound memory.
                parts = [_windows(t) for t in group]
                owner = np.repeat(np.arange(len(group)), [len(p) for p in parts])
                sums = self._sums([w for p in parts for w in p])
                score, hits, count = (_per_owner(x, owner, len(group)) for x in sums)
                found = (hits > 0) & (hits >= min_known * count)
                names = score.argmax(axis=1)
                out += [self.languages[n] if ok else None for n, ok in zip(names, found)]
                group, size = [], 0
        return out

    def detect(self, text: Column, min_known: float = 0.0) -> Column:
        """Language with the highest score (first in name order on a tie).

        Null if the text is blank, has no known trigram, or a smaller share of known ones
        than ``min_known``.
        """
        packed = SparkSession.active().sparkContext.broadcast(
            (self.languages, self.codes, self.weights, self.missing)
        )

        @F.pandas_udf(T.StringType())
        def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            profiles = LanguageProfiles(*packed.value)
            for batch in batches:
                present = batch.notna().to_numpy()
                found = np.full(len(batch), None, dtype=object)
                found[present] = profiles.best(batch[present].tolist(), min_known)
                yield pd.Series(found)

        return best(F.when(~is_blank(text), gram_text(text)))


def _windows(text: str) -> list[str]:
    """Pieces with every trigram of the text in exactly one of them."""
    return [text[i : i + _WINDOW + GRAM - 1] for i in range(0, max(1, len(text) - GRAM + 1), _WINDOW)]


def _per_owner(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, *values.shape[1:]), np.int64)
    np.add.at(out, owner, values)
    return out


def detect_by_join(
    df: DataFrame, text: str, profiles: DataFrame, id_column: str, min_known: float = 0.0
) -> DataFrame:
    """``id_column, detected`` of every text, with a profile table of any size.

    The same scores as :meth:`LanguageProfiles.detect`, summed over a join on trigrams.
    ``id_column`` is unique.
    """
    terms = (
        df.where(~is_blank(F.col(text)))
        .select(id_column, F.explode(grams(F.col(text))).alias("gram"))
        .groupBy(id_column, "gram")
        .agg(F.count("*").alias("_tf"))
    )
    missing = profiles.agg((F.min("weight") - SCALE).alias("_missing"))
    known_grams = profiles.select("gram").distinct().withColumn("_known", F.lit(1))
    sizes = (
        terms.join(known_grams, "gram", "left")
        .groupBy(id_column)
        .agg(F.sum("_tf").alias("_all"), F.sum(F.col("_tf") * F.coalesce("_known", F.lit(0))).alias("_hits"))
    )
    sums = (
        terms.join(profiles.select("lang", "gram", "weight"), "gram")
        .groupBy(id_column, "lang")
        .agg(F.sum(F.col("_tf") * F.col("weight")).alias("_weight"), F.sum("_tf").alias("_own"))
    )
    low = F.lit(missing.first()[0])
    score = F.col("_weight") + low * (F.col("_all") - F.col("_own"))
    best = (
        sums.join(sizes, id_column)
        .where((F.col("_hits") > 0) & (F.col("_hits") >= min_known * F.col("_all")))
        .groupBy(id_column)
        .agg(F.min_by("lang", F.struct(-score, "lang")).alias("detected"))
    )
    return df.select(id_column).join(best, id_column, "left")


def _codes(points: np.ndarray) -> np.ndarray:
    """Every trigram of a code-point array as one 63-bit number."""
    wide = points.astype(np.int64)
    return (wide[:-2] << 42) | (wide[1:-1] << 21) | wide[2:]


def base_language(code: Column) -> Column:
    """``zh-cn`` → ``zh``."""
    return F.substring_index(F.lower(code), "-", 1)


def filter_language(
    df: DataFrame, expected: str | Column, profiles: LanguageProfiles, text: str = "text"
) -> DataFrame:
    """Rows whose detected base language equals the expected base language."""
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    found = base_language(profiles.detect(F.col(text)))
    return df.where(found == base_language(wanted))
