"""Orders over whole tables without a single sorting task: ranges, buckets, positions.

A sample of the distinct keys gives cut points; which range a key falls in is then a Column,
found by two short searches in a literal. Keys end in a hash or digest, so one id that fills
a third of the rows is cut like any other range, unless the rows are equal altogether.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import let, written

#: Keys that are sampled for each range.
KEYS_A_RANGE = 8
#: Ranges for each shuffle partition, and the rows that a range has at least, on average.
RANGES_A_PARTITION = 4
ROWS_A_RANGE = 64


def _literal(row: Row, schema: StructType) -> str:
    """A row as SQL, whatever its strings hold."""
    fields = []
    for value, field in zip(row, schema, strict=True):
        kind = field.dataType.simpleString()
        if value is None:
            made = f"cast(null as {kind})"
        elif kind == "string":
            made = f"cast(unhex('{value.encode().hex()}') as string)"
        else:
            made = f"cast('{value}' as {kind})"
        fields.append(f"'{field.name}', {made}")
    return f"named_struct({', '.join(fields)})"


class Ranges:
    """Ranges with about equal numbers of rows in the ascending order of ``names``, nulls first."""

    def __init__(self, keys: DataFrame, names: list[str], count: int | None = None):
        """keys: a stored table with the columns ``names`` (booleans, integers, strings); read twice."""
        rows = keys.count()
        if count is None:
            partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            count = max(1, min(RANGES_A_PARTITION * partitions, rows // ROWS_A_RANGE))
        self.names, self.cuts = names, []
        if count < 2:
            return
        steps = 1 << 30
        share = min(1.0, KEYS_A_RANGE * count / rows)
        sample = (
            keys.select(*names)
            .where(F.pmod(F.xxhash64(F.lit("cuts"), *names), F.lit(steps)) < int(share * steps))
            .distinct()
            .orderBy(*names)
        )
        found = sample.collect()
        step = len(found) / count
        picked = dict.fromkeys(found[int(i * step)] for i in range(1, count) if int(i * step) < len(found))
        self.cuts = [_literal(row, sample.schema) for row in picked]

    def number(self) -> Column:
        """The number of a row's range (int, from 0)."""
        if not self.cuts:
            return F.lit(0)
        width = max(1, math.isqrt(len(self.cuts)))
        coarse = F.expr(f"array({', '.join(self.cuts[width - 1 :: width])})")
        fine = F.expr(f"array({', '.join(self.cuts)})")

        def upto(cuts: Column, key: Column) -> Column:
            return F.size(F.filter(cuts, lambda cut: cut <= key))

        def found(key: Column, before: Column) -> Column:
            return before + upto(F.slice(fine, before + 1, F.lit(width)), key)

        return let(F.struct(*self.names), lambda key: let(upto(coarse, key) * width, lambda before: found(key, before)))


def with_positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` (from 0, ascending by ``order`` within ``group``) and ``size`` of the group.

    rows: a stored table; ``group`` has no nulls. Rows are numbered through all ranges, and a
    group's numbers begin at its smallest: no group has a task of its own.
    """
    dealt = rows.withColumn("_range", Ranges(rows, [group, *order]).number())
    before, offsets = 0, []
    for row in dealt.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        offsets.append((row["_range"], before))
        before += row["count"]
    offset = dealt.sparkSession.createDataFrame(offsets, "_range int, _before long")
    here = F.row_number().over(Window.partitionBy("_range").orderBy(group, *order)) - 1
    placed = written(
        dealt.withColumn("_here", here)
        .join(F.broadcast(offset), "_range")
        .withColumn("_at", F.col("_before") + F.col("_here"))
        .drop("_range", "_before", "_here")
    )
    groups = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("size"))
    return placed.join(groups, group).withColumn("position", F.col("_at") - F.col("_first")).drop("_at", "_first")
