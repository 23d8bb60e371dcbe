"""Summaries that grow with their corpus: each part is read once, its counts are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentiweave.functions.text import MAX_SEQUENCE_LENGTH
from sentiweave.operators.profile import merged_counts, summary_counts, summary_of_counts
from sentiweave.sources.snapshots import SnapshotTable


class GrowingSummary:
    """The counts of a corpus's parts at ``path``, each under the part's name.

    A part that is counted again takes the place of its earlier counts, so a job that runs
    twice changes nothing. What is kept is a row for each length, label and distinct text.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str] | None = None):
        self.table, self.by = SnapshotTable(spark, path), by or ["language"]

    def parts(self) -> list[str]:
        return sorted(self.table.manifest()["entries"])

    def add(self, part: str, eda: DataFrame) -> None:
        """Count the rows of one part (an EDA frame)."""
        self.table.replace(summary_counts(eda, self.by), part)

    def compact(self, name: str = "all") -> None:
        """All parts as one, under ``name``; they can't be replaced one by one any more."""
        self.table.overwrite(merged_counts(self.table.read(), self.by), name)

    def summary(self, char_threshold: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
        """The summary of all parts together."""
        return summary_of_counts(merged_counts(self.table.read(), self.by), self.by, char_threshold)
