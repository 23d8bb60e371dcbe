"""From documents to tokens: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and gives a frame; all but the last keep the columns
of documents. ``run`` writes each stage's rows as Parquet below the shared folder and reads
them back as the next one's documents, so a lost executor costs one stage at most.

The stages have no SQL equivalent (a trained model, a tokenizer): ORACLE_SQL is None, and
tests hold each stage against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sentiweave.llm import bpe, decontaminate, lines, simhash, toxicity
from sentiweave.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document alone; every document stays."""
    return lines.without_boilerplate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by fingerprints of three-word shingles at most two bits apart, the smallest doc_id stays."""
    return simhash.one_of_each_group(docs, words=3, bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them."""
    return bpe.round_trip_digests(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
