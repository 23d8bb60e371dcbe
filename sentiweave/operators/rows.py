"""Row-wise steps that keep the optimizer from computing a text twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_text(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Set a text column and drop the rows where it is empty.

    A filter on the new column would be pushed below the projection and run the
    cleaning regexes a second time. Exploding a zero-or-one element array does both
    in one evaluation.
    """
    kept = F.filter(F.array(text), lambda t: F.length(t) > 0)
    others = [F.col(c) for c in df.columns if c != name]
    columns = df.select(*others, F.explode(kept).alias(name))
    return columns.select(*(df.columns if name in df.columns else columns.columns))
