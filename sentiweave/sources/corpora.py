"""Study corpora, training sets, and the tables that jobs write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.functions.labels import harmonized
from sentiweave.functions.text import clean
from sentiweave.operators.rows import with_text
from sentiweave.operators.sampling import first_n, seeded_shuffle
from sentiweave.schema import CORPUS_SCHEMA, METRICS_SCHEMA, as_corpus, require_columns
from sentiweave.sources.registry import (
    CORPORA,
    EN_TRAINING_ROWS,
    SEED,
    CorpusSpec,
    read_corpus,
    read_corpus_slice,
    split_slice,
    take_slice,
    validation_specs,
)
from sentiweave.sources.snapshots import SnapshotTable, is_snapshot


def load_corpus_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a corpus; a filter on ``lang`` prunes partitions."""
    parent, _, last = path.rstrip("/").rpartition("/")
    if last.startswith("lang=") and is_snapshot(spark, parent):
        return as_corpus(SnapshotTable(spark, parent).read()).where(F.col("lang") == last.removeprefix("lang="))
    if is_snapshot(spark, path):
        return as_corpus(SnapshotTable(spark, path).read())
    return as_corpus(spark.read.schema(CORPUS_SCHEMA).parquet(path))


def save_corpus_table(df: DataFrame, path: str) -> str:
    """Write a corpus table, one partition per language, in one step.

    Languages present in ``df`` are replaced; others already in the table stay.
    """
    SnapshotTable(df.sparkSession, path).replace_partitions(as_corpus(df), "lang")
    return path


def save_language(df: DataFrame, path: str, language: str) -> str:
    """Put the rows of one language in the place of those that were there; no rows empty it."""
    table = SnapshotTable(df.sparkSession, path)
    table.replace(as_corpus(df).where(F.col("lang") == language), f"lang={language}")
    return path


def raw_table(root: str) -> str:
    return f"{root.rstrip('/')}/raw"


def processed_table(root: str) -> str:
    return f"{root.rstrip('/')}/processed/study"


def raw_corpus_path(root: str, language: str) -> str:
    """Folder of one language inside the raw table."""
    return f"{raw_table(root)}/lang={language}"


def processed_corpus_path(root: str, language: str) -> str:
    """Folder of one language inside the processed table."""
    return f"{processed_table(root)}/lang={language}"


def save_predictions(df: DataFrame, path: str) -> str:
    """Put ``df`` in the place of the predictions at ``path``; see :func:`read_table`."""
    SnapshotTable(df.sparkSession, path).overwrite(df)
    return path


def append_metrics(metrics: DataFrame, path: str, run: str, scope: str) -> str:
    """Add ``(metric, value)`` rows to the metrics table under a run and scope.

    A repeated run replaces its own rows.
    """
    rows = metrics.select(F.lit(run).alias("run"), F.lit(scope).alias("scope"), "metric", "value")
    typed = rows.select(*(F.col(f.name).cast(f.dataType) for f in METRICS_SCHEMA))
    SnapshotTable(metrics.sparkSession, path).replace(typed, f"run={run}/scope={scope}")
    return path


def _labelled_rows(
    df: DataFrame,
    text_column: str,
    label_column: str,
    language: str | Column,
    keep: list[str] | None = None,
) -> DataFrame:
    """Raw text, harmonized label and language of the rows whose label maps to a class."""
    require_columns(df, [text_column, label_column])
    return df.select(
        *(keep or []),
        F.col(text_column).cast("string").alias("text"),
        harmonized(df, label_column).alias("label"),
        (F.lit(language) if isinstance(language, str) else language).alias("language"),
    ).where(F.col("label").isNotNull())


def _cleaned(rows: DataFrame) -> DataFrame:
    return with_text(rows, "text", clean(F.col("text"), F.col("language")))


def training_rows(
    df: DataFrame,
    text_column: str,
    label_column: str,
    language: str | Column,
    keep: list[str] | None = None,
) -> DataFrame:
    """Project a labelled corpus to ``text, label, language``; drop blanks and unmapped labels."""
    return _cleaned(_labelled_rows(df, text_column, label_column, language, keep))


def training_set(
    zh: tuple[DataFrame, str, str],
    en: tuple[DataFrame, str, str],
    id_column: str,
    *,
    en_rows: int | None = EN_TRAINING_ROWS,
    zh_rows: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Mixed training set: heads of both corpora, harmonized, stacked and shuffled.

    Each source is ``(frame, text column, label column)``. Texts are cleaned after the
    sort, which keeps its order: a sort reads its input twice, once to find the ranges.
    """
    parts = []
    for language, (df, text, label), cap in (("zh", zh, zh_rows), ("en", en, en_rows)):
        head = df if cap is None else first_n(df, cap, id_column)
        parts.append(_labelled_rows(head, text, label, language, keep=[id_column]))
    return _cleaned(seeded_shuffle(parts[0].unionByName(parts[1]), id_column, seed))


def validation_set(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Harmonized validation rows of every language in one frame."""
    parts = [training_rows(df, text, label, lang) for lang, (df, text, label) in sources.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def study_corpus(
    df: DataFrame,
    text_column: str,
    *,
    language: str = "zh",
    source: str = "weibo",
    topic: str = "general",
    community: str = "weibo_senti_100k",
    id_column: str | None = None,
) -> DataFrame:
    """A study corpus from a labelled pool: cleaned text, constant columns, ids if there are any."""
    columns = {
        "text": F.col(text_column).cast("string"),
        "lang": F.lit(language),
        "source": F.lit(source),
        "topic": F.lit(topic),
        "community": F.lit(community),
        "timestamp": F.lit(None),
        # A stable id, so that "the first copy" means the same row in every run.
        "post_id": (F.col(id_column).cast("string") if id_column else F.lit("")),
    }
    rows = as_corpus(df.select(*(c.alias(name) for name, c in columns.items())))
    return with_text(rows, "text", clean(F.col("text"), language))


def _one(specs: Sequence[CorpusSpec], role: str, language: str) -> CorpusSpec:
    found = [s for s in specs if s.role == role and s.language == language]
    if len(found) != 1:
        raise ValueError(f"{len(found)} {role} corpora for {language!r} in the registry")
    return found[0]


def load_training_set(
    spark: SparkSession,
    root: str,
    specs: Sequence[CorpusSpec] = CORPORA,
    *,
    en_rows: int = EN_TRAINING_ROWS,
    zh_rows: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The mixed training set from the registry's training corpora below ``root``."""
    zh, en = (_one(specs, "train", language) for language in ("zh", "en"))
    caps = {"zh": zh_rows, "en": en_rows}
    slices = {s.language: s.split if caps[s.language] is None else f"{s.split}[:{caps[s.language]}]" for s in (zh, en)}
    frames = {s.language: read_corpus_slice(spark, root, s, slices[s.language]) for s in (zh, en)}
    if zh.id_column != en.id_column:
        frames["en"] = frames["en"].withColumnRenamed(en.id_column, zh.id_column)
    return training_set(
        (frames["zh"], zh.text_column, zh.label_column),
        (frames["en"], en.text_column, en.label_column),
        zh.id_column,
        en_rows=None,  # the slices are cut already
        seed=seed,
    )


def load_validation_set(
    spark: SparkSession, root: str, specs: Sequence[CorpusSpec] = CORPORA
) -> DataFrame:
    """The validation rows of all languages from the registry's corpora below ``root``."""
    sources = {
        s.language: (take_slice(read_corpus(spark, root, s), s.split, s.id_column), s.text_column, s.label_column)
        for s in validation_specs(tuple(specs))
    }
    return validation_set(sources)


def load_study_corpus(
    spark: SparkSession, root: str, specs: Sequence[CorpusSpec] = CORPORA, max_rows: int | None = None
) -> DataFrame:
    """The Chinese study corpus from the registry's Chinese training corpus."""
    spec = _one(specs, "train", "zh")
    rows = read_corpus_slice(spark, root, spec, split_slice(spec, max_rows))
    return study_corpus(rows, spec.text_column, community=spec.name, id_column=spec.id_column)
