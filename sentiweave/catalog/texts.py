"""Cleaning, labels, copies, chunks and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.catalog.registry import (
    NOTICED,
    NWS,
    Query,
    noticed_documents,
    quality_corpus,
    register,
    sql_clean,
    sql_cut_notice,
    sql_normalize,
    sql_strip,
    table,
    toxic_corpus,
)
from sentiweave.functions.labels import harmonized
from sentiweave.functions.text import (
    chunks,
    drop_moderation_notice,
    fingerprint,
    normalize,
    truncate_tokens,
)
from sentiweave.operators.dedupe import duplicate_rate as rate_of_copies
from sentiweave.operators.dedupe import keep_first
from sentiweave.operators.sampling import first_n, seeded_shuffle, shuffle_key
from sentiweave.operators.sampling import sample_rows as first_rows
from sentiweave.operators.sampling import seeded_cap as cap_rows
from sentiweave.plans.prepare import preprocess
from sentiweave.sources.corpora import study_corpus, training_rows, training_set, validation_set

CATALOG: dict[str, Query] = {}

_WORDS_SQL = """CASE WHEN toxic = 1 AND quality = 1 THEN ' Good ' WHEN toxic = 1 THEN 'NEG'
      WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN '　bad' ELSE source END"""


@register(
    CATALOG,
    f"""WITH t AS (
      SELECT 'page' AS origin, page_id AS id, html AS text FROM pages
      UNION ALL SELECT 'document', doc_id, text FROM documents
      UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)
    SELECT origin, id, {sql_normalize("text")} AS text FROM t""",
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    stacked = pages.unionByName(docs).unionByName(turns)
    return stacked.select("origin", "id", normalize(F.col("text")).alias("text"))


@register(
    CATALOG,
    f"WITH {NOTICED} SELECT doc_id, {sql_cut_notice('text')} AS text FROM noticed",
)
def weibo_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = noticed_documents(spark, sf_dir)
    return docs.select("doc_id", drop_moderation_notice(F.col("text")).alias("text"))


@register(
    CATALOG,
    f"""WITH t AS (
      SELECT doc_id, {_WORDS_SQL} AS raw FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, raw,
           CASE WHEN lower({sql_strip("raw")}) IN ('0', 'negative', 'neg', 'bad') THEN 0
                WHEN lower({sql_strip("raw")}) IN ('1', 'positive', 'pos', 'good') THEN 1
           END AS label
    FROM t""",
)
def harmonize_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    worded = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.expr(_WORDS_SQL).alias("raw")
    )
    return worded.withColumn("label", harmonized(worded, "raw"))


@register(
    CATALOG,
    """WITH t AS (SELECT event_id, value / 10 - 1 AS v, user_id AS k, value > 20 AS b FROM events)
    SELECT event_id,
           CASE WHEN trunc(v) IN (0, 1) THEN trunc(v)::INTEGER END AS from_double,
           CASE WHEN k IN (0, 1) THEN k::INTEGER END AS from_integer,
           b::INTEGER AS from_boolean
    FROM t""",
)
def harmonize_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("value") / 10 - 1).alias("v"),
        F.col("user_id").alias("k"),
        (F.col("value") > 20).alias("b"),
    )
    return rows.select(
        "event_id",
        harmonized(rows, "v").alias("from_double"),
        harmonized(rows, "k").alias("from_integer"),
        harmonized(rows, "b").alias("from_boolean"),
    )


@register(
    CATALOG,
    f"""WITH {NOTICED}, t AS (
      SELECT doc_id, {sql_clean("text", "lang")} AS text,
             CASE toxic WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label, lang AS language
      FROM noticed JOIN labels USING (doc_id))
    SELECT * FROM t WHERE length(text) > 0 AND label IS NOT NULL""",
)
def training_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = toxic_corpus(spark, sf_dir).select("doc_id", "sentiment")
    docs = noticed_documents(spark, sf_dir).join(words, "doc_id")
    return training_rows(docs, "text", "sentiment", F.col("lang"), keep=["doc_id"])


@register(
    CATALOG,
    f"""SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents
    GROUP BY lower({sql_strip("text")})""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (
        docs.groupBy(fingerprint(F.col("text")).alias("copy"))
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        .drop("copy")
    )


@register(
    CATALOG,
    f"""SELECT doc_id, lang, text FROM documents
    QUALIFY row_number() OVER (PARTITION BY lower({sql_strip("text")}) ORDER BY doc_id) = 1""",
)
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return keep_first(docs, "text", "doc_id")


@register(
    CATALOG,
    f"""WITH {NOTICED}, t AS (
      SELECT doc_id, lang, source, {sql_clean("text", "lang")} AS text FROM noticed)
    SELECT doc_id, lang, source, text FROM t WHERE length(text) > 0
    QUALIFY row_number() OVER (PARTITION BY lang, lower({sql_strip("text")}) ORDER BY doc_id) = 1""",
)
def preprocess_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = noticed_documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return preprocess(docs, F.col("lang"), id_column="doc_id", within=("lang",))


@register(
    CATALOG,
    """WITH t AS (
      SELECT doc_id, unnest(range((length(text) + 255) // 256)) AS position, text
      FROM documents)
    SELECT doc_id, position, substr(text, position * 256 + 1, 256) AS chunk FROM t""",
)
def chunk_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.posexplode(chunks(F.col("text"))).alias("position", "chunk")
    ).withColumn("position", F.col("position").cast("long"))


@register(
    CATALOG,
    f"""SELECT doc_id,
           array_to_string(list_slice(regexp_extract_all(text, '{NWS}+'), 1, 256), ' ') AS text
    FROM documents""",
)
def truncate_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", truncate_tokens(F.col("text")).alias("text"))


@register(
    CATALOG,
    f"""WITH {NOTICED},
    zh AS (SELECT doc_id, {sql_clean("text", "lang")} AS text, quality AS label, 'zh' AS language
           FROM noticed JOIN labels USING (doc_id) WHERE lang = 'zh'),
    en AS (SELECT doc_id, {sql_normalize("text")} AS text, 1 - toxic AS label, 'en' AS language
           FROM (SELECT * FROM documents JOIN labels USING (doc_id) WHERE lang = 'en'
                 ORDER BY doc_id LIMIT 150))
    SELECT * FROM zh WHERE length(text) > 0 AND label IN (0, 1)
    UNION ALL SELECT * FROM en WHERE length(text) > 0 AND label IN (0, 1)""",
)
def training_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    zh = noticed_documents(spark, sf_dir).where("lang = 'zh'").join(labels, "doc_id")
    en = toxic_corpus(spark, sf_dir).where("lang = 'en'")
    return training_set(
        (zh, "text", "quality"), (en, "text", "sentiment"), "doc_id", en_rows=150
    )


@register(
    CATALOG,
    f"""WITH {NOTICED}, t AS (
      SELECT {sql_clean("text", "lang")} AS text, quality AS label, lang AS language
      FROM noticed JOIN labels USING (doc_id) WHERE lang IN ('zh', 'de', 'en', 'fr'))
    SELECT * FROM t WHERE length(text) > 0 AND label IN (0, 1)""",
)
def validation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = noticed_documents(spark, sf_dir).join(labels, "doc_id")
    sources = {code: (docs.where(F.col("lang") == code), "text", "quality") for code in ("zh", "de", "en", "fr")}
    return validation_set(sources)


@register(
    CATALOG,
    f"""WITH {NOTICED}, t AS (
      SELECT {sql_cut_notice(sql_normalize("text"))} AS text FROM noticed WHERE lang = 'zh')
    SELECT text, 'zh' AS lang, 'weibo' AS source, 'general' AS topic,
           'weibo_senti_100k' AS community, NULL::VARCHAR AS timestamp, '' AS post_id
    FROM t WHERE length(text) > 0""",
)
def study_corpus_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = noticed_documents(spark, sf_dir).where("lang = 'zh'")
    return study_corpus(pool, "text").withColumn("timestamp", F.col("timestamp").cast("string"))


@register(CATALOG, "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 500")
def split_head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), 500, "doc_id")


@register(
    CATALOG,
    "SELECT doc_id, md5(doc_id || '-42') AS shuffle_key, text FROM documents",
)
def shuffled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded_shuffle(table(spark, sf_dir, "documents"), "doc_id", 42)
    return docs.select("doc_id", shuffle_key("doc_id", 42).alias("shuffle_key"), "text")


@register(
    CATALOG,
    """SELECT doc_id, lang, text FROM documents
    ORDER BY md5(doc_id || '-42'), doc_id LIMIT 200""",
)
def seeded_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), 200, "doc_id", 42)


@register(
    CATALOG,
    """SELECT doc_id, quality, text FROM documents JOIN labels USING (doc_id)
    QUALIFY row_number() OVER (
      PARTITION BY quality ORDER BY md5(doc_id || '-42'), doc_id) <= 50""",
)
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_corpus(spark, sf_dir).select("doc_id", "quality", "text")
    return cap_rows(rows, 50, "doc_id", 42, strata=["quality"])


@register(
    CATALOG,
    """SELECT text, quality FROM documents JOIN labels USING (doc_id)
    ORDER BY doc_id LIMIT 3""",
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(quality_corpus(spark, sf_dir), "text", "quality", "doc_id", 3)


@register(
    CATALOG,
    f"""WITH c AS (
      SELECT lang, lower({sql_strip("text")}) AS k, count(*) AS n FROM documents
      WHERE regexp_matches(text, '{NWS}') GROUP BY ALL)
    SELECT lang, sum(n)::BIGINT AS n_texts,
           round_even(sum(n - 1)::DOUBLE / sum(n)::DOUBLE * 10000, 0) / 10000 AS duplicate_rate
    FROM c GROUP BY lang""",
)
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_of_copies(table(spark, sf_dir, "documents"), "text", ["lang"])
