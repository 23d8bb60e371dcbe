"""Whitening of embeddings: leading eigenpairs of the covariance by spectrum slicing.

Entries become integers x, so all sums over the table are exact and don't depend on how
rows are dealt: tasks add up their rows' sums and products (centred at the whole numbers next
to the mean, the rest taken off exactly), and only the d x d result reaches the driver. There
the signs of the pivots of an LDL' factorisation of V - sI count the eigenvalues above s
(Sylvester's law of inertia). Bisection by these counts gives each leading eigenvalue an
interval of its own, Rayleigh quotient iteration converges cubically inside, and counts just
below and above what it found certify the number of the component. Then tasks project all rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, plus, share, table, written

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Beyond this scaled entries are cut off (they no longer fit a long otherwise).
LARGEST = 4.0e18
#: Pivots of an indefinite matrix are 1 x 1 if large enough, else 2 x 2 (Bunch and Parlett).
ALPHA = (1 + math.sqrt(17)) / 8
EPS = np.finfo(float).eps


def whole_entries(vector: Column) -> Column:
    """x = floor(64 c) + 1,000,000 of each entry, null for vectors with null or non-finite entries."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:
        cut = F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(cut).cast("long") + OFFSET

    return F.when((F.size(vector) > 0) & usable, F.transform(wide, whole))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of an Arrow list column, all of one size."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _exactly(value: np.ndarray) -> np.ndarray:
    """As Python integers if sums of a few such arrays might not fit a long."""
    if value.dtype == np.int64 and value.size and max(-int(value.min()), int(value.max())) >= 1 << 61:
        return value.astype(object)
    return value


def _added(one: list[np.ndarray] | None, more: list[np.ndarray]) -> list[np.ndarray]:
    if one is None:
        return more
    return [_exactly(a) + _exactly(b) for a, b in zip(one, more, strict=True)]


def table_sums(rows: DataFrame, of: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The sum over all batches of the arrays that ``of`` gives; None without rows.

    Tasks hold one set of arrays; their sums meet in a few tasks, then in one, as a row each.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = _added(total, of(batch))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column(0):
                total = _added(total, pickle.loads(packed.as_py()))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sums"])

    few = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = rows.mapInArrow(first, "sums binary").repartition(few).mapInArrow(again, "sums binary")
    last = found.repartition(1).mapInArrow(again, "sums binary").collect()
    return pickle.loads(last[0]["sums"]) if last else None


def products(rows: np.ndarray) -> np.ndarray:
    """rows' @ rows of integers, exact."""
    size = rows.shape[1]
    largest = max(-int(rows.min()), int(rows.max())) if rows.size else 0
    total = np.zeros((size, size), np.int64)
    if largest >= 1 << 26:
        wide = rows.astype(object)
        return wide.T @ wide
    step = max(1, (1 << 53) // max(1, largest * largest))  # so many rows' sums are exact in doubles
    for start in range(0, len(rows), step):
        part = rows[start : start + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def inertia(a: np.ndarray) -> tuple[int, int]:
    """Positive and negative eigenvalues of a symmetric matrix, by its LDL' factors."""
    a = a.copy()
    above = below = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0.0)
        r, c = divmod(int(off.argmax()), len(a))
        if diagonal[p] == 0 and off[r, c] == 0:
            break
        if diagonal[p] >= ALPHA * off[r, c]:
            above, below = (above + 1, below) if a[p, p] > 0 else (above, below + 1)
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[p, p])
        else:  # a block with one eigenvalue of either sign
            above, below = above + 1, below + 1
            pair = [r, c]
            rest = np.delete(np.arange(len(a)), pair)
            columns = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
    return above, below


def _solved(a: np.ndarray, shift: float, b: np.ndarray, norm: float) -> np.ndarray:
    """(a - shift I)^-1 b; a shift that is an eigenvalue is moved by a rounding error."""
    for nudge in (0.0, EPS * norm, -4 * EPS * norm):
        try:
            found = np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("no shift near an eigenvalue gives a solvable system")


@dataclass(frozen=True)
class Slice:
    """An interval (low, high] with the eigenvalues of numbers ``first`` to ``last`` (from 1, falling)."""

    low: float
    high: float
    first: int
    last: int


class Spectrum:
    """Leading eigenpairs of a symmetric positive semidefinite matrix."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.norm = float(np.abs(v).sum(axis=1).max()) if v.size else 0.0
        #: Eigenvalues below can't be told from zero.
        self.least = 8 * len(v) * EPS * self.norm

    def over(self, shift: float) -> int:
        """Eigenvalues above ``shift``."""
        return inertia(self.v - shift * np.eye(len(self.v)))[0]

    def slices(self, wanted: int) -> list[Slice]:
        """Intervals with one leading eigenvalue each, or with several that can't be parted."""
        if self.norm == 0:
            return []
        top = self.norm * (1 + 4 * EPS)
        count = self.over(self.least)
        wanted = min(wanted, count)
        waiting, found = [Slice(self.least, top, 1, count)] if count else [], []
        while waiting:
            part = waiting.pop()
            if part.first > wanted:
                continue
            middle = (part.low + part.high) / 2
            if part.first == part.last or part.high - part.low <= 16 * EPS * self.norm:
                found.append(part)
                continue
            over = min(max(self.over(middle), part.first - 1), part.last)
            if over >= part.first:
                waiting.append(Slice(middle, part.high, part.first, over))
            if over < part.last:
                waiting.append(Slice(part.low, middle, over + 1, part.last))
        return sorted(found, key=lambda part: part.first)

    def pairs(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues, falling, and unit eigenvectors as columns; their numbers are certified."""
        values, vectors = [], np.zeros((len(self.v), 0))
        for part in self.slices(wanted):
            for _ in range(part.first, min(part.last, wanted) + 1):
                value, vector = self._iterate(part, vectors)
                values.append(value)
                vectors = np.column_stack([vectors, vector])
        order = np.argsort(-np.array(values), kind="stable")
        values, vectors = np.array(values)[order], vectors[:, order]
        for number, value in enumerate(values, 1):
            self.certify(number, value)
        return values, vectors

    def _iterate(self, part: Slice, known: np.ndarray) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration, kept inside of the slice and apart from known vectors."""
        low, high = part.low, part.high
        slack = self.least / 4
        vector = np.random.default_rng(part.first).normal(size=len(self.v))
        while True:
            shift = (low + high) / 2
            for step in range(40):
                vector = vector - known @ (known.T @ vector)
                vector /= np.linalg.norm(vector)
                if step >= 2:
                    quotient = vector @ self.v @ vector
                    rest = np.linalg.norm(self.v @ vector - quotient * vector)
                    if rest <= 4 * len(self.v) * EPS * self.norm and low - slack <= quotient <= high + slack:
                        # One more step from a converged pair takes the vector to rounding error.
                        last = _solved(self.v, quotient, vector, self.norm)
                        last -= known @ (known.T @ last)
                        last /= np.linalg.norm(last)
                        return float(last @ self.v @ last), last
                    # Inverse iteration at the middle goes on until the quotient is inside and near.
                    if low < quotient <= high and rest < (high - low) / 8:
                        shift = quotient
                vector = _solved(self.v, shift, vector, self.norm)
            middle = (low + high) / 2
            if not low < middle < high:
                raise ArithmeticError(f"no convergence for the eigenvalue in ({low}, {high}]")
            if self.over(middle) >= part.first:
                low = middle
            else:
                high = middle

    def certify(self, number: int, value: float) -> None:
        """Raises unless the eigenvalue of this number lies at ``value``, to rounding error."""
        near = 16 * len(self.v) * EPS * self.norm
        if not (self.over(value + near) < number <= self.over(value - near)):
            raise ArithmeticError(f"eigenvalue {number} isn't at {value}")


@dataclass(frozen=True)
class Whitener:
    """What tasks need to whiten rows: exact sums, and a d x k projection."""

    n: int
    sums: np.ndarray  # S, Python integers
    centre: np.ndarray  # whole numbers next to S / n
    shift: np.ndarray  # S / n - centre
    projection: np.ndarray  # unit eigenvectors over the root of their eigenvalues
    explained: np.ndarray
    identity_error: float = math.nan

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.shift) @ self.projection

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; null if that doesn't fit a long."""
        z = x - self.centre
        rest = self.sums - self.n * self.centre.astype(object)
        largest = (int(np.abs(z).max()) if z.size else 0) * self.n + max((abs(int(r)) for r in rest), default=0)
        if largest * largest * x.shape[1] < 1 << 62:
            return ((z * self.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((z.astype(object) * self.n - rest) ** 2).sum(axis=1)
        return [int(e) if e < 1 << 63 else None for e in exact]


def most_frequent_size(fit: DataFrame) -> int | None:
    """The length that most vectors have, of equal counts the larger one."""
    found = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found and found["size"]


def covariance(fit: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, S, the whole numbers next to S / n, and V of the rows x, correctly rounded."""

    def totals(batch: pa.RecordBatch) -> list[np.ndarray]:
        x = matrix(batch.column(0), size)
        largest = max(-int(x.min()), int(x.max()))
        wide = x if largest * len(x) < 1 << 62 else x.astype(object)
        return [np.array([len(x)]), wide.sum(axis=0)]

    count, sums = table_sums(fit, totals)
    n, sums = int(count[0]), np.array([int(s) for s in sums], object)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def moments(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [products(matrix(batch.column(0), size) - centre)]

    (second,) = table_sums(fit, moments)
    rest = sums - n * centre.astype(object)
    # n * sum(z z') - (sum z)(sum z)' in whole numbers, rounded once.
    exact = n * second.astype(object) - np.outer(rest, rest)
    return n, sums, centre, (exact / (n * n)).astype(np.float64)


def fit_whitener(fit: DataFrame, size: int, components: int = COMPONENTS) -> Whitener:
    """fit: a stored table of distinct vectors x, all of one size."""
    n, sums, centre, v = covariance(fit, size)
    values, vectors = Spectrum(v).pairs(min(components, size))
    shift = np.array([float(r) for r in (sums - n * centre.astype(object))]) / n
    made = Whitener(n, sums, centre, shift, vectors / np.sqrt(values), values / np.trace(v) if len(values) else values)
    if not len(values):
        return made
    shared = share(fit.sparkSession, made)

    def moments(batch: pa.RecordBatch) -> list[np.ndarray]:
        w = shared().whitened(matrix(batch.column(0), size))
        return [w.sum(axis=0), w.T @ w]

    first, second = table_sums(fit, moments)
    found = second / n - np.outer(first / n, first / n)  # the mean is zero but for rounding
    error = float(np.abs(found - np.eye(len(values))).max())
    return Whitener(**(made.__dict__ | {"identity_error": error}))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector (column ``embedding``) and component.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are
    those of another length than most. Rows that repeat a vec_id are rows like any others.
    Components end with the rank of the covariance: a table without rows, or of equal vectors
    alone, gives no rows.
    """
    spark = vectors.sparkSession
    entries = vectors.select("vec_id", whole_entries(F.col("embedding")).alias("x")).where("x is not null")
    fit = written(entries.select("x").distinct())
    size = most_frequent_size(fit)
    schema = plus(
        vectors.select("vec_id").schema,
        "component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
    if size is None:
        return spark.createDataFrame([], schema)
    fitted = fit_whitener(fit.where(F.size("x") == size), size, components)
    shared = share(spark, fitted)
    count = len(fitted.explained)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared()
        x = matrix(batch.column(1), size)
        at = pa.array(np.repeat(np.arange(len(x)), count))
        constant = [own.n, own.identity_error]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), constant[0])),
                pa.array(own.deviation(x), pa.int64()).take(at),
                pa.array(own.whitened(x).ravel()),
                pa.array(np.tile(own.explained, len(x))),
                pa.array(np.full(len(at), constant[1])),
            ],
            schema=None,
            names=schema.names,
        )

    return arrow_map(entries.where(F.size("x") == size), schema, rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
