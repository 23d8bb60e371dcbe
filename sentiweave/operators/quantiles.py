"""Exact ranks of values of any kind, without a window over all of a group's values.

1. One pass makes a mergeable sketch per group (``percentile_approx``), whose rank error is
   bounded: for each wanted rank it gives a value surely below it and one surely above.
2. A second pass counts the rows below each such bracket, and the distinct values inside it.
   Only values inside of brackets are put in order: a share of about 4 / ACCURACY of a group.
3. The value at the rank is read off the ordered counts. A bracket that missed its rank
   (the counts tell) is widened and taken again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentiweave.operators.histogram import at_rank

#: Relative accuracy of the sketches: a rank is known up to rows / ACCURACY.
ACCURACY = 10_000
_BROADCAST_ROWS = 10_000


def _position(q: float, total: Column) -> Column:
    """The 0-based rank of a quantile among ``total`` rows, as a double."""
    return F.lit(q) * (total - 1)


def exact_ranks(
    df: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, str]], accuracy: int = ACCURACY
) -> DataFrame:
    """A row per group: the values at the ranks ``floor`` or ``ceil`` of q * (rows - 1), and ``total``.

    ranks: result column -> (q, "floor" or "ceil"). Nulls and NaNs are left out; groups
    without other values have no row.
    """
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_g0")]
    names = [f"_g{i}" for i in range(len(groups))]
    kind = df.schema[value].dataType.simpleString()
    rows = df.select(*groups, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if kind in ("float", "double"):
        rows = rows.where(~F.isnan("_v"))
    slack = 2 / accuracy
    while True:
        edges = []
        for q, _ in ranks.values():
            edges += [max(0.0, q - slack), min(1.0, q + slack)]
        sketch = rows.groupBy(*names).agg(
            F.count("*").alias("total"), F.percentile_approx("_v", edges, accuracy).alias("_edges")
        )
        wanted = []
        for i, (name, (q, side)) in enumerate(ranks.items()):
            spot = _position(q, F.col("total"))
            low = F.lit(None).cast(kind) if q - slack <= 0 else F.get("_edges", F.lit(2 * i))
            high = F.lit(None).cast(kind) if q + slack >= 1 else F.get("_edges", F.lit(2 * i + 1))
            wanted.append(
                F.struct(
                    F.lit(name).alias("name"),
                    (F.floor(spot) if side == "floor" else F.ceil(spot)).cast("long").alias("rank"),
                    low.alias("low"),
                    high.alias("high"),
                )
            )
        # One row per group; few of them are computed once and go to the rows.
        brackets = sketch.select(*names, "total", F.array(*wanted).alias("_wanted"))
        found = brackets.limit(_BROADCAST_ROWS + 1).collect()
        if len(found) <= _BROADCAST_ROWS:
            brackets = F.broadcast(df.sparkSession.createDataFrame(found, brackets.schema))
        same = [F.col(n).eqNullSafe(F.col(f"{n}_r")) for n in names]
        renamed = brackets.select(*(F.col(n).alias(f"{n}_r") for n in names), "total", "_wanted")
        met = rows.join(renamed, reduce(Column.__and__, same))
        above = lambda w: w["high"].isNotNull() & (F.col("_v") > w["high"])
        # A row is counted for brackets that it lies in, or below which it lies.
        part = F.explode(F.filter("_wanted", lambda w: ~above(w))).alias("w")
        counted = (
            met.select(*names, "total", "_v", part)
            .select(*names, "total", F.col("w.name").alias("_name"), F.col("w.rank").alias("_rank"),
                    F.when(F.col("w.low").isNull() | (F.col("_v") >= F.col("w.low")), F.col("_v")).alias("_inside"))
            .groupBy(*names, "total", "_name", "_rank", "_inside")
            .agg(F.count("*").alias("n"))
        )
        each = Window.partitionBy(*names, "_name")
        sofar = each.orderBy(F.col("_inside").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = counted.withColumns({"upto": F.sum("n").over(sofar)})
        read = running.groupBy(*names, "total", "_name", "_rank").agg(
            F.max("upto").alias("_most"),
            F.coalesce(F.max(F.when(F.col("_inside").isNull(), F.col("n"))), F.lit(0)).alias("_less"),
            at_rank(F.col("_rank"), "_inside").alias("_value"),
        )
        missed = (F.col("_less") > F.col("_rank")) | (F.col("_most") <= F.col("_rank"))
        read = read.withColumn("_missed", missed)
        result = read.groupBy(*names, "total").agg(
            *(F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in ranks),
            F.max("_missed").alias("_missed"),
        )
        found = result.limit(_BROADCAST_ROWS + 1).collect()
        if len(found) <= _BROADCAST_ROWS:
            result = df.sparkSession.createDataFrame(found, result.schema)
            again = any(row["_missed"] for row in found)
        else:
            again = not result.where("_missed").limit(1).isEmpty()
        if slack >= 1 or not again:
            return result.select(*(F.col(n).alias(c) for n, c in zip(names, by)), "total", *ranks)  # noqa: B905
        slack = min(1.0, 4 * slack)


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Floor-index quantiles per group of values of any kind, one column per entry of ``qs``."""
    found = exact_ranks(df, by, value, {name: (q, "floor") for name, q in qs.items()})
    return found.drop("total")


def exact_boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """As :func:`sentiweave.operators.histogram.boxplot_stats`, for values of any kind."""
    qs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ranks = {f"{name}_{side}": (q, side) for name, q in qs.items() for side in ("floor", "ceil")}
    found = exact_ranks(df, by, value, ranks)

    def between(name: str, q: float) -> Column:
        low, high = (F.col(f"{name}_{side}").cast("double") for side in ("floor", "ceil"))
        spot = _position(q, F.col("total"))
        return low + (high - low) * (spot - F.floor(spot))

    keys = by or ["_all"]
    found = found if by else found.withColumn("_all", F.lit(0))
    boxes = found.select(*keys, *(between(name, q).alias(name) for name, q in qs.items()))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = boxes.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    kept = fences.limit(_BROADCAST_ROWS + 1).collect()
    if len(kept) <= _BROADCAST_ROWS:
        fences = F.broadcast(df.sparkSession.createDataFrame(kept, fences.schema))
    groups = [F.col(c) for c in by] or [F.lit(0)]
    rows = df.select(*(g.alias(f"_r{i}") for i, g in enumerate(groups)), F.col(value).alias("_v")).where("_v is not null")
    same = [F.col(f"_r{i}").eqNullSafe(F.col(c)) for i, c in enumerate(keys)]
    met = rows.join(fences, reduce(Column.__and__, same))
    inside = F.col("_v").cast("double").between(F.col("_low"), F.col("_high"))
    return met.groupBy(*by, *qs).agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside & ~F.isnan(F.col("_v").cast("double"))).alias("n_outliers"),
    )
