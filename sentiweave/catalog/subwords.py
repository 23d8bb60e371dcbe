"""Subword pieces of a public vocabulary, words of texts without spaces, exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.catalog.registry import Query, register, sql_round, table
from sentiweave.functions.numeric import round_to
from sentiweave.functions.text import truncate_tokens
from sentiweave.operators import profile, quantiles
from sentiweave.operators.segmentation import WordGraph, tokenization_gaps, without_spaces, word_counts, word_lengths
from sentiweave.operators.subwords import Subwords

CATALOG: dict[str, Query] = {}


@register(CATALOG)
def subword_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it again."""
    subwords = Subwords(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", subwords.ids(F.col("text")).alias("ids"))
    back = subwords.text_of(F.col("ids")).eqNullSafe(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "ids", back.alias("round_trip"))


@register(CATALOG)
def subword_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in subwords, special tokens included, of all rows per language."""
    docs = table(spark, sf_dir, "documents")
    return profile.token_length_stats(docs, "text", "doc_id", Subwords(spark).tokenizer(), by=["lang"])


@register(CATALOG)
def subword_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut to the sequence budget in subwords."""
    tokenizer = Subwords(spark).tokenizer()
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", truncate_tokens(F.col("text"), tokenizer=tokenizer).alias("text"))


@register(CATALOG)
def unspaced_tokenization_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with their spaces taken out: words found again, and how subwords cut them."""
    docs = table(spark, sf_dir, "documents")
    graph = WordGraph.fit(word_counts(docs, "text"))
    rows = docs.select("lang", without_spaces(F.col("text")).alias("text"), word_lengths(F.col("text")).alias("lengths"))
    return tokenization_gaps(rows, "text", ["lang"], graph, Subwords(spark), F.col("lengths"))


def _ranked_sql(column: str, qs: dict[str, float]) -> str:
    at = ", ".join(f"max(v) FILTER (WHERE i = floor({q} * (n - 1))::BIGINT) AS {name}" for name, q in qs.items())
    return f"""WITH r AS (SELECT l_returnflag, {column} AS v,
           row_number() OVER (PARTITION BY l_returnflag ORDER BY {column}) - 1 AS i,
           count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE {column} IS NOT NULL)
    SELECT l_returnflag, {at} FROM r GROUP BY l_returnflag"""


_QS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@register(CATALOG, _ranked_sql("l_extendedprice", _QS))
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _QS)


@register(
    CATALOG,
    f"""WITH t AS (SELECT l_linestatus, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS v FROM lineitem),
    q AS (SELECT l_linestatus, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                 quantile_cont(v, 0.75) AS q3 FROM t GROUP BY ALL),
    i AS (SELECT *, v BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE AS inside
          FROM t JOIN q USING (l_linestatus))
    SELECT l_linestatus, {sql_round("any_value(q1)", 4)} AS q1, {sql_round("any_value(median)", 4)} AS median,
           {sql_round("any_value(q3)", 4)} AS q3, {sql_round("min(v) FILTER (WHERE inside)", 4)} AS whisker_low,
           {sql_round("max(v) FILTER (WHERE inside)", 4)} AS whisker_high,
           count(*) FILTER (WHERE NOT inside) AS n_outliers
    FROM i GROUP BY l_linestatus""",
)
def unit_price_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", unit.alias("v"))
    boxes = quantiles.exact_boxplot(rows, ["l_linestatus"], "v")
    return boxes.withColumns({c: round_to(F.col(c), 4) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})
