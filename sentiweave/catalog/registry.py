"""Helpers to pair a Spark query with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.functions.text import MODERATION_NOTICE


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def register(catalog: dict[str, Query], sql: str | None = None) -> Callable:
    """Add the decorated ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        catalog[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# SQL fragments used by the oracles: the 29 whitespace characters as a plain class.
_SPACES = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{_SPACES}]"
NWS = f"[^{_SPACES}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_normalize(x: str) -> str:
    plain = f"replace(coalesce({x}, ''), chr(0), '')"
    unlinked = f"regexp_replace({plain}, 'https?://{NWS}+', '', 'g')"
    return f"trim(regexp_replace({unlinked}, '{WS}+', ' ', 'g'))"


def sql_cut_notice(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '(?s){WS}*{MODERATION_NOTICE}.*', '')")


def sql_clean(x: str, lang: str) -> str:
    return f"CASE WHEN {lang} = 'zh' THEN {sql_cut_notice(sql_normalize(x))} ELSE {sql_normalize(x)} END"


def sql_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NWS}+'))"


def sql_round(x: str, digits: int) -> str:
    scale = 10**digits
    return f"(round_even(({x})::DOUBLE * {scale}, 0) / {scale})"


# The tables hold no Chinese. Spanish rows stand in for it: they get language zh and a
# moderation notice, followed by the text again, so that the cut has something to remove.
NOTICE_TAIL = f"　{MODERATION_NOTICE}社区公约\n"


def noticed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    zh = F.col("lang") == "es"
    tail = F.concat(F.col("text"), F.lit(NOTICE_TAIL), F.col("text"))
    return docs.withColumn("text", F.when(zh, tail).otherwise(F.col("text"))).withColumn(
        "lang", F.when(zh, "zh").otherwise(F.col("lang"))
    )


NOTICED = f"""noticed AS (
  SELECT doc_id, source, n_chars,
         CASE WHEN lang = 'es' THEN text || '{NOTICE_TAIL}' || text ELSE text END AS text,
         CASE WHEN lang = 'es' THEN 'zh' ELSE lang END AS lang
  FROM documents)"""


# Two labelled corpora with different encodings, as the study has them.
def quality_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id")


def toxic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    word = F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "positive")
    return docs.join(labels.select("doc_id", word.alias("sentiment")), "doc_id")
