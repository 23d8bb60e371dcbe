"""Label harmonization to {0 negative, 1 positive, null unmapped}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiweave.functions.text import strip

# The words accepted for each class.
NEGATIVE_WORDS = ("0", "negative", "neg", "bad")
POSITIVE_WORDS = ("1", "positive", "pos", "good")


def harmonize(label: Column, kind: T.DataType) -> Column:
    """Map a label column of Spark type ``kind`` to 0, 1 or null.

    Numbers are truncated towards zero first, so 0.5 and -0.5 are 0 and 1.9 is 1.
    """
    if isinstance(kind, T.BooleanType):
        return label.cast("int")
    if isinstance(kind, T.NumericType):
        return F.when((label > -1) & (label < 1), 0).when((label >= 1) & (label < 2), 1)
    word = F.lower(strip(label.cast("string")))
    return F.when(word.isin(*NEGATIVE_WORDS), 0).when(word.isin(*POSITIVE_WORDS), 1)


def harmonized(df: DataFrame, column: str) -> Column:
    """``harmonize`` with the type looked up in the frame's schema."""
    return harmonize(F.col(column), df.schema[column].dataType)
