"""Study preprocessing: clean, drop blanks, keep first copies, keep the expected language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.functions.text import clean
from sentiweave.operators.rows import with_text
from sentiweave.operators.dedupe import keep_first
from sentiweave.operators.langid import LanguageProfiles, filter_language
from sentiweave.schema import require_columns
from sentiweave.sources.corpora import load_corpus_table, save_corpus_table


def preprocess(
    df: DataFrame,
    language: str | Column,
    *,
    text_column: str = "text",
    id_column: str = "id",
    within: tuple[str, ...] = (),
    clean_notices: bool = False,
    dedupe: bool = True,
    profiles: LanguageProfiles | None = None,
) -> DataFrame:
    """Run the preprocessing chain; all languages go in one pass.

    ``language`` is the expected language: a code or a column. Copies are removed
    before languages are checked, since that decides which copy survives. ``within``
    limits copies to equal values (such as the language) of those columns. Without
    ``profiles`` the language check is skipped.
    """
    require_columns(df, [text_column])
    text = clean(F.col(text_column), language, force_notice=clean_notices)
    rows = with_text(df, text_column, text)
    if dedupe:
        rows = keep_first(rows, text_column, id_column, within)
    if profiles is not None:
        rows = filter_language(rows, language, profiles, text_column)
    return rows


def preprocess_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    language: str,
    *,
    clean_notices: bool = False,
    dedupe: bool = True,
    profiles: LanguageProfiles | None = None,
) -> str:
    """Read a corpus, preprocess it, write it. First copies are those with the lowest post id."""
    rows = preprocess(
        load_corpus_table(spark, input_path).where(F.col("lang") == language),
        language,
        id_column="post_id",
        clean_notices=clean_notices,
        dedupe=dedupe,
        profiles=profiles,
    )
    return save_corpus_table(rows, output_path)
