"""Checks that run while a table is written: counts of broken rules, and rows set apart.

Rules are evaluated on the job's own pass over the rows. Each row is written with the rules
that it breaks, as bits of a number, and rows that break one go to a partition of their own in
the same write; readers take the others. The counts are read off that one column of what has
been written, so that the source is scanned once. (``DataFrame.observe`` would count, too, but
a session that has observed anything can't ship fitted classifiers to tasks any more.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.schema import require_columns
from sentiweave.sources.snapshots import SnapshotTable

REJECTED, BROKEN = "_rejected", "_broken"
#: Rules that fit a number's bits.
MAX_RULES = 62


def in_range(column: str, low: float, high: float) -> Column:
    """A rule: the value is there and in the closed range."""
    return F.col(column).isNotNull() & F.col(column).between(low, high)


def present(column: str) -> Column:
    """A rule: the text is there and isn't blank."""
    return F.col(column).isNotNull() & (F.trim(F.col(column)) != "")


def parses(column: str, kind: str) -> Column:
    """A rule: a text is missing or can be read as ``kind`` (any type name of Spark)."""
    return F.col(column).isNull() | F.col(column).try_cast(kind).isNotNull()


def write_checked(df: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """Write ``df`` in one step; rows per rule that break it, and ``rows`` and ``rejected`` in all.

    A rule that gives null for a row is broken by it.
    """
    if {REJECTED, BROKEN} & set(df.columns) or not 0 < len(rules) <= MAX_RULES:
        raise ValueError(f"1 to {MAX_RULES} rules are needed, and no column named {REJECTED} or {BROKEN}")
    bits = [
        F.when(F.coalesce(rule, F.lit(False)), F.lit(0)).otherwise(F.lit(1 << i)).cast("long")
        for i, rule in enumerate(rules.values())
    ]
    flagged = df.withColumn(BROKEN, reduce(Column.__add__, bits)).withColumn(REJECTED, F.col(BROKEN) != 0)
    table = SnapshotTable(df.sparkSession, path)
    version = table.replace_all_partitions(flagged, REJECTED)
    # At most a row for each set of rules that some row breaks.
    sets = table.read(version).groupBy(BROKEN).count()
    counts = sets.agg(
        F.coalesce(F.sum("count"), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col(BROKEN) != 0, F.col("count"))), F.lit(0)),
        *(
            F.coalesce(F.sum(F.when(F.col(BROKEN).bitwiseAND(F.lit(1 << i)) != 0, F.col("count"))), F.lit(0))
            for i in range(len(rules))
        ),
    ).first()
    return dict(zip(["rows", "rejected", *rules], counts, strict=True))


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The rows that broke no rule."""
    return SnapshotTable(spark, path).read().where(~F.col(REJECTED)).drop(REJECTED, BROKEN)


def rejected(spark: SparkSession, path: str, rules: list[str]) -> DataFrame:
    """The rows that were set apart, with the names of the ``rules`` that each breaks."""
    names = F.array(*map(F.lit, rules))
    broken = F.filter(names, lambda _, i: F.col(BROKEN).bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0)
    return SnapshotTable(spark, path).read().where(F.col(REJECTED)).withColumn("broken_rules", broken).drop(REJECTED, BROKEN)


def violations(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """``(rule, violations)`` of the counts of a write."""
    rows = [(rule, n) for rule, n in counts.items() if rule not in ("rows", "rejected")]
    return spark.createDataFrame(rows, "rule string, violations long")


def require_rules(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Rules from closed ranges, one per column."""
    require_columns(df, ranges)
    return {c: in_range(c, low, high) for c, (low, high) in ranges.items()}
