"""Collection jobs: posts of a language's communities, from a table or as they arrive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentiweave.operators.sampling import newest_n
from sentiweave.sources.corpora import raw_table, save_language
from sentiweave.sources.posts import COMMUNITIES, POST_COLUMNS, TOPICS, collect_posts, in_communities, post_rows, with_topic
from sentiweave.sources.snapshots import SnapshotTable

POST_SCHEMA = "id string, title string, selftext string, created_utc long, community string"


def collect_job(
    spark: SparkSession,
    posts_path: str,
    root: str,
    language: str,
    limit_per_community: int | None = None,
) -> str:
    """Read posts, keep the newest per community (or all), replace the language in the raw table."""
    posts = spark.read.parquet(posts_path).select(*POST_COLUMNS)
    rows = collect_posts(posts, language, limit_per_community=limit_per_community)
    return save_language(rows, raw_table(root), language)


def one_of_each_post(posts: DataFrame) -> DataFrame:
    """One row of posts that were delivered more than once: the latest, of equal times the largest.

    Posts are told apart by community and id; those without an id are all kept.
    """
    others = [c for c in posts.columns if c not in ("community", "id", "created_utc")]
    version = F.struct("created_utc", *others)
    named = posts.where("id is not null").groupBy("community", "id").agg(F.max(version).alias("last"))
    return named.select("community", "id", "last.*").select(*posts.columns).unionByName(posts.where("id is null"))


class NewestPosts:
    """The newest posts per community of a stream, as a table that each batch replaces in one step.

    What is newest doesn't depend on the order of arrival: a late post takes its place, one
    that is delivered again changes nothing, and so doesn't a batch that is run again.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        language: str,
        limit_per_community: int,
        communities: Mapping[str, Sequence[str]] = COMMUNITIES,
        topics: Mapping[str, str] = TOPICS,
    ):
        if language not in communities:
            raise ValueError(f"Unsupported language: {language!r}")
        self.root, self.language, self.limit = root.rstrip("/"), language, limit_per_community
        self.communities, self.topics = communities[language], topics
        self.held = SnapshotTable(spark, f"{self.root}/newest/{language}")

    def posts(self) -> DataFrame:
        return self.held.read()

    def rows(self) -> DataFrame:
        """The posts held as corpus rows."""
        return post_rows(with_topic(self.posts(), self.topics), self.language)

    def take(self, batch: DataFrame, number: int = 0) -> None:
        """Merge a batch of posts into the table, and publish the language's corpus rows."""
        mine = in_communities(batch.select(*POST_COLUMNS), self.communities)
        # Most of a batch is dropped before it meets the posts held.
        found = newest_n(one_of_each_post(mine), self.limit, "community", "created_utc", "id")
        if self.held.versions():
            found = one_of_each_post(self.posts().unionByName(found))
            found = newest_n(found, self.limit, "community", "created_utc", "id")
        self.held.overwrite(found.select(*POST_COLUMNS))
        self.held.expire(2)
        save_language(self.rows(), raw_table(self.root), self.language)

    def follow(self, posts: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Start the stream ``posts``; without a trigger it takes what is there and stops."""
        writer = posts.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def collect_arrivals(
    spark: SparkSession,
    posts_path: str,
    root: str,
    language: str,
    limit_per_community: int,
    files_per_batch: int = 1_000,
) -> NewestPosts:
    """Take the post files that have arrived below ``posts_path`` since the last call."""
    newest = NewestPosts(spark, root, language, limit_per_community)
    stream = (
        spark.readStream.schema(POST_SCHEMA).option("maxFilesPerTrigger", str(files_per_batch)).parquet(posts_path)
    )
    newest.follow(stream, f"{newest.root}/_streams/{language}").awaitTermination()
    return newest


def first_deliveries(posts: DataFrame, delay: str) -> DataFrame:
    """A stream of posts without repeated deliveries that come within ``delay`` of each other.

    State is bounded by the watermark; posts later than ``delay`` behind the newest go.
    """
    timed = posts.withColumn("posted", F.timestamp_seconds("created_utc"))
    return timed.withWatermark("posted", delay).dropDuplicatesWithinWatermark(["community", "id"]).drop("posted")
