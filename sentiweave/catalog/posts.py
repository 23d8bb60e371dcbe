"""Posts: merge, topic lookup, newest per community, collection, source audit."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.catalog.registry import Query, register, sql_normalize, table
from sentiweave.functions.text import merge_title_body
from sentiweave.operators.metrics import audit_sources
from sentiweave.operators.metrics import range_violations as violations
from sentiweave.operators.sampling import first_n, newest_n
from sentiweave.sources.posts import collect_posts as collect
from sentiweave.sources.posts import with_topic

CATALOG: dict[str, Query] = {}

# Stand-ins for the configured communities and topics.
_COMMUNITIES = {"en": ("src0", "src1", "src2", "src5"), "es": ("src3", "src4")}
_TOPICS = {"src0": "apple", "src1": "technology", "src2": "chatgpt", "src3": "politics"}
_TOPIC_SQL = "CASE source " + " ".join(
    f"WHEN '{c}' THEN '{t}'" for c, t in _TOPICS.items()
) + " ELSE 'general' END"


def _seconds(ts: str):
    """Epoch seconds of a zone-free timestamp."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def _first_line(text):
    return F.substring_index(text, "\n", 1)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as submissions: first line as title, the rest as body, time of an event."""
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    text = F.col("text")
    return docs.join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id").select(
        F.col("doc_id").alias("id"),
        _first_line(text).alias("title"),
        F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("selftext"),
        _seconds("ts").alias("created_utc"),
        F.col("source").alias("community"),
    )


def _merge_sql(title: str, body: str) -> str:
    t, b = sql_normalize(title), sql_normalize(body)
    return f"CASE WHEN length({b}) > 0 THEN trim({t} || '. ' || {b}, '. ') ELSE {t} END"


_TITLE, _BODY = "split_part(text, chr(10), 1)", "substr(text, length(split_part(text, chr(10), 1)) + 2)"


@register(
    CATALOG,
    f"SELECT conv_id, turn, {_merge_sql(_TITLE, _BODY)} AS text FROM conversations",
)
def post_title_body_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumns(
        {
            "title": _first_line(F.col("text")),
            "body": F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)"),
        }
    )
    return turns.select(
        "conv_id", "turn", merge_title_body(F.col("title"), F.col("body")).alias("text")
    )


@register(
    CATALOG,
    """SELECT event_type, event_id, epoch_us(ts) // 1000000 AS created_utc FROM events
    QUALIFY row_number() OVER (
      PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 DESC, event_id) <= 500""",
)
def posts_newest_n_per_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_type", "event_id", _seconds("ts").alias("created_utc")
    )
    return newest_n(events, 500, "event_type", "created_utc", "event_id")


@register(
    CATALOG,
    """WITH e AS (SELECT event_type, event_id,
           CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000000 // 86400 * 86400 END AS day FROM events)
    SELECT event_type, event_id, day FROM e
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC NULLS LAST, event_id) <= 1500""",
)
def newest_n_null_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days as times, so that many are equal, and every seventh missing."""
    day = F.floor(_seconds("ts") / 86400) * 86400
    events = table(spark, sf_dir, "events").select(
        "event_type", "event_id", F.when(F.col("event_id") % 7 != 0, day).alias("day")
    )
    return newest_n(events, 1500, "event_type", "day", "event_id")


@register(
    CATALOG,
    """WITH d AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN source || '-' || doc_id END AS id, lang, n_chars
              FROM documents)
    SELECT * FROM d ORDER BY id NULLS LAST LIMIT 600""",
)
def first_n_string_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, name).alias("id"), "lang", "n_chars"
    )
    return first_n(docs, 600, "id")


@register(CATALOG, f"SELECT doc_id, source AS community, {_TOPIC_SQL} AS topic FROM documents")
def posts_topic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("community"))
    return with_topic(posts, _TOPICS).select("doc_id", "community", "topic")


@register(
    CATALOG,
    f"""WITH p AS (
      SELECT d.doc_id, d.text, d.source, epoch_us(e.ts) // 1000000 AS created
      FROM documents d JOIN events e ON d.doc_id = e.event_id
      WHERE d.source IN ('src0', 'src1', 'src2', 'src5')
      QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY created DESC, d.doc_id) <= 20)
    SELECT {_merge_sql(_TITLE, _BODY)} AS text, 'en' AS lang, 'reddit' AS source,
           {_TOPIC_SQL} AS topic, source AS community, created AS created_utc,
           doc_id::VARCHAR AS post_id
    FROM p""",
)
def collect_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collect(
        _posts(spark, sf_dir),
        "en",
        limit_per_community=20,
        communities=_COMMUNITIES,
        topics=_TOPICS,
    )
    return rows.withColumn("created_utc", F.unix_seconds("timestamp")).drop("timestamp")


@register(
    CATALOG,
    """SELECT 'documents' AS source, count(*) AS n_rows, '' AS errors, count(*) > 0 AS ok FROM documents
    UNION ALL SELECT 'labels', count(*), 'missing column label', false FROM labels
    UNION ALL SELECT 'conversations', count(*), '', count(*) > 0 FROM conversations
    UNION ALL SELECT 'benchmark', count(*), 'missing column lang, missing column label', false
    FROM benchmark
    UNION ALL SELECT 'nowhere', 0, 'cannot load: AnalysisException', false""",
)
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = {
        "documents": ["text", "lang"],
        "labels": ["doc_id", "label"],
        "conversations": ["text", "role"],
        "benchmark": ["text", "lang", "label"],
    }
    sources = {n: (partial(table, spark, sf_dir, n), cols) for n, cols in required.items()}
    return audit_sources(sources | {"nowhere": (partial(table, spark, sf_dir, "nowhere"), ["text"])})


@register(
    CATALOG,
    """WITH e AS (SELECT CASE WHEN vec_id % 5 <> 0 THEN label END AS label, embedding FROM embeddings)
    SELECT 'sentiment_label' AS rule,
           count(*) FILTER (WHERE label IS NULL OR NOT label BETWEEN 0 AND 1) AS violations FROM e
    UNION ALL SELECT 'sentiment_score',
           count(*) FILTER (WHERE NOT list_min(embedding)::DOUBLE BETWEEN 0 AND 1) FROM e
    UNION ALL SELECT 'confidence',
           count(*) FILTER (WHERE NOT list_max(embedding)::DOUBLE BETWEEN 0 AND 1) FROM e""",
)
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        # Every fifth label is missing here, which is a violation, too.
        F.when(F.col("vec_id") % 5 != 0, F.col("label")).alias("sentiment_label"),
        F.array_min("embedding").cast("double").alias("sentiment_score"),
        F.array_max("embedding").cast("double").alias("confidence"),
    )
    return violations(rows)
