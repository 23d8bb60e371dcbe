"""Heads, seeded shuffles, caps and newest-N.

Only keys are ordered: Spark's own order and limit (a rank per stratum, if there are strata)
give the n-th key, and full rows are kept where they lie if their key is not above it. A
stratum may hold most rows: it is ranked in SALTS parts first, of which each hands on n keys.

Nulls and NaNs come last. The order columns alone are read unless rows are equal in them at
the n-th key; these are told apart by a hash of the row. Rows that are equal altogether are
interchangeable, and as many are kept as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cut tables (one row per stratum) up to so many rows are broadcast.
_BROADCAST_ROWS = 10_000
#: Parts that a stratum's keys are ranked in before they meet.
SALTS = 64


def shuffle_key(id_column: str, seed: int) -> Column:
    """Pseudo-random order key that depends only on id and seed, not on partitioning."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"-{seed}")))


def seeded_shuffle(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    """All rows in a repeatable random order (a range-partitioned sort)."""
    return df.orderBy(shuffle_key(id_column, seed), id_column)


def _edges(keys: DataFrame, n: int, groups: list[str]) -> DataFrame:
    """The n-th ``_key`` of each group as ``_edge`` and the one after it as ``_after``, null where there is none."""
    part = Window.partitionBy(*groups, "_salt").orderBy("_key")
    whole = Window.partitionBy(*groups).orderBy("_key")
    ranked = (
        keys.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
        .withColumn("_nth", F.row_number().over(part))
        .where(F.col("_nth") <= n + 1)
        .withColumn("_nth", F.row_number().over(whole))
        .where(F.col("_nth") <= n + 1)
    )
    return ranked.groupBy(*groups).agg(
        F.max(F.when(F.col("_nth") == n, F.col("_key"))).alias("_edge"),
        F.max(F.when(F.col("_nth") == n + 1, F.col("_key"))).alias("_after"),
    )


def _constant(row: Row, kind: T.StructType) -> Column:
    return F.struct(*(F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind))


def _select_first(
    df: DataFrame, n: int, order: dict[str, Column], strata: list[str], unique: bool, tie: bool = False
) -> DataFrame:
    """The first n rows of each stratum by the order columns (and a hash of the row, if ``tie``)."""
    if n <= 0:
        return df.limit(0)
    groups = {f"_g{i}": F.col(c) for i, c in enumerate(strata)}
    plain = {c: F.when(F.isnan(v), None).otherwise(v) if _is_float(df, v) else v for c, v in order.items()}
    first = next(iter(plain))
    last = [F.xxhash64(*_hashable(df)).alias("_tie")] if tie else []
    key = F.struct(plain[first].isNull().alias("_null"), *(v.alias(c) for c, v in plain.items()), *last)
    keyed = df.withColumns({**groups, "_key": key})
    keys = keyed.select(*groups, "_key")
    if not strata:
        found = [r["_key"] for r in keys.orderBy("_key").offset(n - 1).limit(2).collect()]
        if len(found) < 2:
            return df
        full = found[0] == found[1]
        inside = F.col("_key") <= _constant(found[0], keys.schema["_key"].dataType)
        below = keyed.where(inside)
    else:
        edges = _edges(keys, n, list(groups))
        # One row per stratum: few of them become a table of their own, computed once.
        found = edges.limit(_BROADCAST_ROWS + 1).collect()
        few = len(found) <= _BROADCAST_ROWS
        if few:
            full = any(row["_after"] is not None and row["_edge"] == row["_after"] for row in found)
            edges = df.sparkSession.createDataFrame(found, edges.schema)
        else:
            full = not edges.where(F.col("_edge") == F.col("_after")).limit(1).isEmpty()
        inside = F.col("_edge").isNull() | (F.col("_key") <= F.col("_edge"))
        below = _attach(keyed, edges, list(groups), few).where(inside)
    if full and not unique and not tie:
        return _select_first(df, n, order, strata, unique, tie=True)
    if full:  # more equal rows at the edge than fit
        nth = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_key")
        below = below.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= n)
    return below.select(*df.columns)


def _is_float(df: DataFrame, value: Column) -> bool:
    return isinstance(df.select(value).schema[0].dataType, (T.FloatType, T.DoubleType))


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]


def _attach(rows: DataFrame, cut: DataFrame, groups: list[str], few: bool) -> DataFrame:
    """A join with one row per stratum; broadcast if there are few, so full rows stay."""
    renamed = cut.select(*(F.col(g).alias(f"{g}_r") for g in groups), *(c for c in cut.columns if c not in groups))
    if few:
        renamed = F.broadcast(renamed)
    same = [F.col(g).eqNullSafe(F.col(f"{g}_r")) for g in groups]
    return rows.join(renamed, same).drop(*(f"{g}_r" for g in groups))


def first_n(
    df: DataFrame, n: int, id_column: str, unique: bool = False, strata: list[str] | None = None
) -> DataFrame:
    """The first n rows (of each stratum) in the order of an id (numbers or text), null ids last.

    ``unique`` says that no id occurs twice; then no other column is read for ties.
    """
    return _select_first(df, n, {"_id": F.col(id_column)}, strata or [], unique)


def seeded_cap(
    df: DataFrame, n: int, id_column: str, seed: int, strata: list[str] | None = None
) -> DataFrame:
    """The first n rows of the seeded shuffle, or n per stratum. Row order is not kept."""
    order = {"_shuffled": shuffle_key(id_column, seed)}
    return _select_first(df, n, order, strata or [], unique=False)


def newest_n(
    df: DataFrame, n: int, group: str, created: str, id_column: str, unique: bool = False
) -> DataFrame:
    """The n newest rows per group, undated rows last; equal times are taken in id order.

    ``created`` is numeric (epoch seconds).
    """
    order = {"_age": -F.col(created).cast("double"), "_id": F.col(id_column)}
    return _select_first(df, n, order, [group], unique)


def sample_rows(
    df: DataFrame, text_column: str, label_column: str, id_column: str, n: int = 3
) -> DataFrame:
    """Text and label of the first n rows, for manual inspection."""
    picked = first_n(df.select(text_column, label_column, id_column), n, id_column)
    return picked.orderBy(F.col(id_column).asc_nulls_last(), text_column).select(text_column, label_column)
