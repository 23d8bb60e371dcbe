"""Tables that jobs write: atomic replacement, repeated runs, posts collected as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.catalog import posts as post_queries
from sentiweave.catalog.registry import Query, register, table
from sentiweave.operators import quality
from sentiweave.plans.collect import POST_SCHEMA, NewestPosts
from sentiweave.session import scratch_path
from sentiweave.sources.corpora import append_metrics, load_corpus_table, save_corpus_table, save_language
from sentiweave.sources.snapshots import SnapshotTable, read_table
from sentiweave.sources.splits import read_slice, write_split

CATALOG: dict[str, Query] = {}


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    constant = {"topic": F.lit("general"), "community": F.col("source"), "timestamp": F.lit(None)}
    return docs.withColumns(constant | {"post_id": F.col("doc_id").cast("string")})


@register(
    CATALOG,
    """SELECT doc_id::VARCHAR AS post_id, lang, source, length(text) AS n_chars FROM documents
    WHERE lang NOT IN ('en', 'fr') OR (lang = 'en' AND length(text) > 500)""",
)
def replaced_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole corpus, then English replaced by its longer texts and French by nothing; old folders dropped."""
    corpus, path = _corpus(spark, sf_dir), scratch_path(spark, "corpus")
    save_corpus_table(corpus, path)
    save_corpus_table(corpus.where("lang = 'en' and length(text) > 500"), path)
    save_language(corpus.limit(0), path, "fr")
    SnapshotTable(spark, path).expire(1)
    return load_corpus_table(spark, path).select("post_id", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@register(
    CATALOG,
    """SELECT r.run, lang AS scope, metric, value FROM (VALUES ('first'), ('second')) AS r(run),
    (SELECT lang, count(*)::DOUBLE AS rows, sum(n_chars)::DOUBLE AS chars FROM documents GROUP BY lang)
    UNPIVOT (value FOR metric IN (rows, chars))""",
)
def metrics_of_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two runs, each written twice: a repeated run adds no rows."""
    path = scratch_path(spark, "metrics")
    docs = table(spark, sf_dir, "documents")
    sums = docs.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars")).collect()
    for run in ("first", "second", "second", "first"):
        for row in sums:  # one for each language
            measured = [(name, float(row[name])) for name in ("rows", "chars")]
            append_metrics(spark.createDataFrame(measured, "metric string, value double"), path, run, row["lang"])
    return read_table(spark, path)


@register(CATALOG, post_queries.CATALOG["collect_posts"].sql)
def collect_posts_as_they_arrive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts land in files in any order, some twice; the stream ends with the newest of each community."""
    posts = post_queries._posts(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), "title", "selftext", "created_utc", "community"
    )
    root = scratch_path(spark, "arrivals")
    again = posts.where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    posts.unionByName(again).repartition(6, F.xxhash64(F.lit("chunk"), "id", F.length("title"))).write.parquet(f"{root}/landed")
    newest = NewestPosts(spark, root, "en", 20, post_queries._COMMUNITIES, post_queries._TOPICS)
    stream = spark.readStream.schema(POST_SCHEMA).option("maxFilesPerTrigger", "2").parquet(f"{root}/landed")
    newest.follow(stream, f"{root}/checkpoint").awaitTermination()
    rows = newest.rows()
    return rows.withColumn("created_utc", F.unix_seconds("timestamp")).drop("timestamp")


@register(CATALOG, "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 250")
def split_head_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``train[:250]`` of a split in files of 60 rows: five of them are opened."""
    path = scratch_path(spark, "split")
    write_split(table(spark, sf_dir, "documents"), path, "train", "doc_id", 60)
    return read_slice(spark, path, "train[:250]", "doc_id").select("doc_id", "lang", "source", "n_chars")


_RULES_SQL = {
    "label": "label IS NOT NULL AND label BETWEEN 0 AND 1",
    "lowest": "list_min(embedding) IS NOT NULL AND list_min(embedding)::DOUBLE BETWEEN -2 AND 0",
    "kind": "TRY_CAST(CASE WHEN vec_id % 3 = 0 THEN 'x' || vec_id ELSE vec_id::VARCHAR END AS BIGINT) IS NOT NULL",
}


@register(
    CATALOG,
    "SELECT * FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE NOT ("
    + " AND ".join(f"({rule})" for rule in _RULES_SQL.values())
    + ")) AS rejected, "
    + ", ".join(f"count(*) FILTER (WHERE NOT ({rule})) AS {name}" for name, rule in _RULES_SQL.items())
    + " FROM embeddings) UNPIVOT (n FOR measure IN (rows, rejected, label, lowest, kind))",
)
def checked_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per broken rule, counted from what is written; ``rejected`` as read back."""
    text = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("x"), F.col("vec_id"))).otherwise(F.col("vec_id").cast("string"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.array_min("embedding").cast("double").alias("lowest"), text.alias("kind")
    )
    rules = quality.require_rules(rows, {"label": (0, 1), "lowest": (-2.0, 0.0)}) | {"kind": quality.parses("kind", "long")}
    path = scratch_path(spark, "checked")
    counts = quality.write_checked(rows, path, rules)
    found = spark.createDataFrame(
        [(name, n) for name, n in counts.items() if name != "rejected"], "measure string, n long"
    )
    apart = quality.rejected(spark, path, list(rules)).agg(F.lit("rejected").alias("measure"), F.count("*").alias("n"))
    return found.unionByName(apart)
