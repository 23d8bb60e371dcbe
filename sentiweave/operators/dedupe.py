"""Exact copies by trimmed, lower-cased text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentiweave.functions.numeric import ratio, round_to
from sentiweave.functions.text import fingerprint, is_blank


def keep_first(
    df: DataFrame, text_column: str = "text", id_column: str = "id", within: tuple[str, ...] = ()
) -> DataFrame:
    """Keep the copy with the lowest id of every text (per ``within`` columns); of equal ids
    the one whose exact text has the lowest hash.

    ``row_number() = 1`` is reduced before the shuffle, so each map task sends at
    most one row per text: a text that makes up a third of the corpus does not
    land on one reducer. Rows without copies are shuffled once, as they must be.
    """
    # Order and partition are fixed-size values: a text that isn't asked for isn't shuffled.
    first = Window.partitionBy(*within, "_copy").orderBy(id_column, "_tie")
    return (
        df.withColumns(
            {"_copy": fingerprint(F.col(text_column)), "_tie": F.xxhash64(text_column)}
        )
        .withColumn("_nth", F.row_number().over(first))
        .where(F.col("_nth") == 1)
        .drop("_copy", "_tie", "_nth")
    )


def duplicate_rate(df: DataFrame, text_column: str, by: list[str] | None = None) -> DataFrame:
    """Share of non-blank texts that repeat an earlier one, 0.0 when there are none."""
    by = by or []
    text = F.col(text_column)
    blank = is_blank(text)
    per_text = (
        df.select(*by, F.when(~blank, fingerprint(text)).alias("_copy"))
        .groupBy(*by, "_copy")
        .agg(F.count("_copy").alias("_n"))
    )
    extra = F.sum(F.greatest(F.col("_n") - 1, F.lit(0)))
    return per_text.groupBy(*by).agg(
        F.sum("_n").alias("n_texts"),
        F.coalesce(round_to(ratio(extra, F.sum("_n")), 4), F.lit(0.0)).alias("duplicate_rate"),
    )
