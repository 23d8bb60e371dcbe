"""The labelled corpora known to the study, their caps and split slices."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiweave.operators.sampling import first_n, seeded_cap
from sentiweave.schema import require_columns
from sentiweave.sources.splits import parse_slice, read_slice

# Seeds and row caps.
SEED = 42
INSPECTION_ROWS = 2_000
EN_TRAINING_ROWS = 100_000


@dataclass(frozen=True)
class CorpusSpec:
    """Where a labelled corpus lies and how its rows are read.

    ``folder`` is below the root that a loader is given. ``role`` is train, validation or
    inspection; ``rows`` caps a training corpus in id order.
    """

    name: str
    folder: str
    role: str
    language: str
    text_column: str
    label_column: str
    split: str = "train"
    format: str = "parquet"
    id_column: str = "row_id"
    rows: int | None = None
    dataset_id: str = ""
    load_note: str = ""


# The baseline corpora, and the full English training source.
CORPORA: tuple[CorpusSpec, ...] = (
    CorpusSpec(
        "weibo_senti_100k", "weibo_senti_100k", "train", "zh", "review", "label",
        dataset_id="dirtycomputer/weibo_senti_100k",
    ),
    CorpusSpec(
        "sentiment140", "sentiment140", "train", "en", "text", "label",
        rows=EN_TRAINING_ROWS, dataset_id="sentiment140",
    ),
    CorpusSpec(
        "sentiment140_mirror", "sentiment140_mirror", "inspection", "en", "clean_tweet", "sentiment",
        rows=EN_TRAINING_ROWS, dataset_id="Roh2014/sentiment140_10k_tweets",
        load_note="10k-row mirror for inspection; training takes the head of the full set.",
    ),
    CorpusSpec(
        "ChnSentiCorp", "ChnSentiCorp", "validation", "zh", "text", "label", "validation",
        dataset_id="lansinuote/ChnSentiCorp", load_note="Parquet mirror of the planned corpus.",
    ),
    CorpusSpec(
        "sst2", "sst2/sst2", "validation", "en", "sentence", "label", "validation",
        dataset_id="nyu-mll/glue",
    ),
)


def training_specs(specs: tuple[CorpusSpec, ...] = CORPORA) -> tuple[CorpusSpec, ...]:
    return tuple(s for s in specs if s.role == "train")


def validation_specs(specs: tuple[CorpusSpec, ...] = CORPORA) -> tuple[CorpusSpec, ...]:
    return tuple(s for s in specs if s.role == "validation")


def registry_frame(spark: SparkSession, specs: tuple[CorpusSpec, ...] = CORPORA) -> DataFrame:
    """The registry as a table: one row per spec."""
    schema = T.StructType(
        [
            T.StructField(name, T.LongType() if name == "rows" else T.StringType())
            for name in CorpusSpec.__dataclass_fields__
        ]
    )
    return spark.createDataFrame([tuple(asdict(s).values()) for s in specs], schema)


def note_row_cap(spec: CorpusSpec, max_rows: int | None) -> CorpusSpec:
    """Add the inspection cap to the spec's note."""
    if max_rows is None:
        return spec
    parts = [spec.load_note, f"Inspection cap: {max_rows:,} rows."]
    return replace(spec, load_note=" ".join(p for p in parts if p))


def with_row_cap(registry: DataFrame, max_rows: int | None) -> DataFrame:
    """``note_row_cap`` on a registry table."""
    if max_rows is None:
        return registry
    note = F.concat_ws(
        " ", F.nullif("load_note", F.lit("")), F.lit(f"Inspection cap: {max_rows:,} rows.")
    )
    return registry.withColumn("load_note", note)


def split_slice(spec: CorpusSpec, max_rows: int | None = None) -> str:
    """``split`` or ``split[:N]``; an explicit cap wins over the spec's own."""
    cap = spec.rows if max_rows is None else max_rows
    return spec.split if cap is None else f"{spec.split}[:{cap}]"


def take_slice(df: DataFrame, slice_: str, id_column: str) -> DataFrame:
    """Rows of a ``split`` or ``split[:N]`` slice; N counts rows in id order."""
    name, cap = parse_slice(slice_)
    rows = df.where(F.col("split") == name) if "split" in df.columns else df
    return rows if cap is None else first_n(rows, cap, id_column)


def corpus_path(root: str, spec: CorpusSpec) -> str:
    """Table folder of a corpus, with one ``split=`` partition per split."""
    return f"{root.rstrip('/')}/{spec.folder}"


def read_corpus(spark: SparkSession, root: str, spec: CorpusSpec) -> DataFrame:
    """The spec's whole table. Filters on ``split`` prune partitions."""
    df = spark.read.format(spec.format).load(corpus_path(root, spec))
    return require_columns(df, [spec.text_column, spec.label_column, spec.id_column])


def read_corpus_slice(spark: SparkSession, root: str, spec: CorpusSpec, slice_: str) -> DataFrame:
    """A slice of the spec's table; of a Parquet table a head opens the files alone that hold it."""
    if spec.format != "parquet":
        return take_slice(read_corpus(spark, root, spec), slice_, spec.id_column)
    df = read_slice(spark, corpus_path(root, spec), slice_, spec.id_column)
    return require_columns(df, [spec.text_column, spec.label_column, spec.id_column])


def load_corpus(
    spark: SparkSession, root: str, spec: CorpusSpec, max_rows: int | None = None
) -> DataFrame:
    """One labelled corpus: the full slice, or a seeded sample if ``max_rows`` asks for one."""
    if max_rows is None:
        return read_corpus_slice(spark, root, spec, split_slice(spec))
    df = read_corpus(spark, root, spec)
    return seeded_cap(take_slice(df, spec.split, spec.id_column), max_rows, spec.id_column, SEED)
