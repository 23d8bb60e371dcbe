"""Community posts: from a table of landed submissions to corpus rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiweave.functions.numeric import epoch_to_timestamp
from sentiweave.functions.text import merge_title_body
from sentiweave.operators.sampling import newest_n
from sentiweave.schema import CORPUS_SCHEMA, require_columns

# Communities per language, and the topic of each.
COMMUNITIES: dict[str, tuple[str, ...]] = {
    "en": ("apple", "technology", "ChatGPT"),
    "es": ("es", "spain", "preguntareddit", "podemos"),
}
TOPICS: dict[str, str] = {
    "apple": "apple",
    "technology": "technology",
    "ChatGPT": "chatgpt",
    "es": "general",
    "spain": "general",
    "preguntareddit": "general",
    "podemos": "politics",
}
DEFAULT_TOPIC = "general"
POST_COLUMNS = ("id", "title", "selftext", "created_utc", "community")

_BROADCAST_ROWS = 10_000


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a lookup built from ``rows`` driver-side entries while that is small."""
    return F.broadcast(table) if rows <= _BROADCAST_ROWS else table


def with_topic(
    posts: DataFrame, topics: Mapping[str, str] = TOPICS, default: str = DEFAULT_TOPIC
) -> DataFrame:
    """Look up each post's topic by community."""
    table = posts.sparkSession.createDataFrame(
        list(topics.items()), "community string, topic string"
    )
    return posts.join(_small(table, len(topics)), "community", "left").withColumn(
        "topic", F.coalesce("topic", F.lit(default))
    )


def in_communities(posts: DataFrame, communities: Sequence[str]) -> DataFrame:
    """Posts of the listed communities."""
    table = posts.sparkSession.createDataFrame([(c,) for c in communities], "community string")
    return posts.join(_small(table, len(communities)), "community", "left_semi")


def post_rows(posts: DataFrame, language: str, source: str = "reddit") -> DataFrame:
    """Corpus rows of posts that already carry a topic."""
    columns = {
        "text": merge_title_body(F.col("title"), F.col("selftext")),
        "lang": F.lit(language),
        "source": F.lit(source),
        "topic": F.col("topic"),
        "community": F.col("community"),
        "timestamp": epoch_to_timestamp(F.col("created_utc")),
        "post_id": F.col("id").cast("string"),
    }
    return posts.select(
        *(columns[f.name].cast(f.dataType).alias(f.name) for f in CORPUS_SCHEMA)
    )


def collect_posts(
    posts: DataFrame,
    language: str,
    *,
    limit_per_community: int | None = None,
    communities: Mapping[str, Sequence[str]] = COMMUNITIES,
    topics: Mapping[str, str] = TOPICS,
) -> DataFrame:
    """Newest posts of a language's communities as corpus rows (typed even when empty).

    Without a limit all posts are taken.
    """
    if language not in communities:
        raise ValueError(f"Unsupported language: {language!r}")
    require_columns(posts, POST_COLUMNS)
    mine = in_communities(posts.select(*POST_COLUMNS), communities[language])
    newest = mine
    if limit_per_community is not None:
        newest = newest_n(mine, limit_per_community, "community", "created_utc", "id")
    return post_rows(with_topic(newest, topics), language)
