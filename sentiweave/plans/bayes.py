"""A word-count naive Bayes classifier in closed form: counts, a join, integer log odds.

Fitting is one grouped count, written once; the vocabulary stays a table of any size. Words
with a certain share of the training words (so there are few of them, and most words of a text
are of them) go to the tasks, which add up their weights where the texts lie; other words alone
are shuffled to the vocabulary. Log odds are whole thousandths, so sums don't depend on their
order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiweave.functions.text import NWS
from sentiweave.session import scratch_path

SCALE = 1_000
#: Words with at least one of so many of the training words are frequent; there can't be more of them.
FREQUENT = 100_000


def _words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({NWS}+)"))
    return df.select(*keep, F.explode(found).alias("word"))


def _thousandths(value: Column) -> Column:
    return F.rint(F.log(value) * SCALE).cast("long")


@dataclass(frozen=True)
class BayesModel:
    """``words``: word and weight. ``unseen``: weight of other words. ``prior``: log odds.

    ``frequent``: the part of ``words``, of bounded size, that goes to the tasks.
    """

    words: DataFrame
    unseen: int
    prior: int
    frequent: DataFrame | None = None

    @classmethod
    def fit(cls, train: DataFrame, text: str = "text", label: str = "label") -> BayesModel:
        """Fit on rows with a label of 0 or 1 (others are left out), with add-one smoothing."""
        rows = train.where(F.col(label).isin(0, 1)).select(text, F.col(label).alias("_y"))
        counts = (
            _words(rows, text, "_y")
            .groupBy("word")
            .agg(F.count_if(F.col("_y") == 1).alias("n1"), F.count_if(F.col("_y") == 0).alias("n0"))
        )
        path = scratch_path(train.sparkSession, "words")
        counts.write.parquet(path)
        counts = train.sparkSession.read.schema("word string, n1 long, n0 long").parquet(path)
        size = counts.agg(F.count("*"), F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0))).first()
        docs = rows.agg(F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)).first()
        one, zero = (float(size[0] + size[i] + 1) for i in (1, 2))
        odds = ((F.col("n1") + 1) / F.lit(one)) / ((F.col("n0") + 1) / F.lit(zero))
        small = train.sparkSession.range(1).select(
            _thousandths(F.lit(zero) / F.lit(one)), _thousandths(F.lit(docs[0] + 1.0) / F.lit(docs[1] + 1.0))
        ).first()
        weight = _thousandths(odds).alias("weight")
        often = (F.col("n1") + F.col("n0")) * FREQUENT >= size[1] + size[2]
        words, frequent = (rows.select("word", weight) for rows in (counts, counts.where(often)))
        return cls(words, small[0], small[1], frequent)

    def score(self, df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
        """``id_column, log_odds, sentiment_label, sentiment_score`` of every row.

        A text without words has the prior. ``id_column`` is unique.
        """
        rest, known = _words(df, text, id_column), None
        if self.frequent is not None:
            known = rest.join(F.broadcast(self.frequent), "word").select(id_column, "weight")
            rest = rest.join(F.broadcast(self.frequent.select("word")), "word", "left_anti")
        found = rest.join(self.words, "word", "left").select(id_column, F.coalesce("weight", F.lit(self.unseen)).alias("weight"))
        # Sums of each text are small: they meet after a first sum in the tasks.
        parts = [rows.groupBy(id_column).agg(F.sum("weight").alias("_sum")) for rows in (known, found) if rows is not None]
        sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy(id_column).agg(F.sum("_sum").alias("_sum"))
        total = (F.lit(self.prior) + F.coalesce("_sum", F.lit(0))).cast("long")
        odds = F.greatest(F.least(F.col("log_odds") / SCALE, F.lit(500.0)), F.lit(-500.0))
        return (
            df.select(id_column)
            .join(sums, id_column, "left")
            .select(id_column, total.alias("log_odds"))
            .withColumn("sentiment_label", (F.col("log_odds") > 0).cast("int"))
            .withColumn("sentiment_score", 1 / (1 + F.exp(-odds)))
        )
