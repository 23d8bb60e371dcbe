import pytest
from pyspark.sql import functions as F

from sentiweave.operators.sampling import (
    first_n,
    newest_n,
    sample_rows,
    seeded_cap,
    seeded_shuffle,
    shuffle_key,
)
from sentiweave.sources import corpora, posts, registry

SPECS = {s.name: s for s in registry.CORPORA}


def test_registry(spark):
    assert [s.name for s in registry.training_specs()] == ["weibo_senti_100k", "sentiment140"]
    assert [s.name for s in registry.validation_specs()] == ["ChnSentiCorp", "sst2"]
    assert {s.language for s in registry.CORPORA} == {"zh", "en"}
    table = registry.registry_frame(spark)
    assert table.where("role = 'train'").count() == 2
    assert table.where("name = 'sentiment140'").first().rows == 100_000


def test_split_slices():
    spec = SPECS["sentiment140"]
    assert registry.split_slice(spec, 2_000) == "train[:2000]"
    assert registry.split_slice(spec) == "train[:100000]"
    assert registry.split_slice(SPECS["weibo_senti_100k"]) == "train"


def test_row_cap_notes(spark):
    spec = SPECS["weibo_senti_100k"]
    assert registry.note_row_cap(spec, None) == spec
    assert registry.note_row_cap(spec, 2_000).load_note == "Inspection cap: 2,000 rows."
    noted = registry.with_row_cap(registry.registry_frame(spark), 2_000)
    assert {r.name: r.load_note for r in noted.collect()} == {
        s.name: registry.note_row_cap(s, 2_000).load_note for s in registry.CORPORA
    }


def ordered(spark, n=100):
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
        (F.col("id") >= n // 2).cast("int").alias("label"),
    )


def test_first_n(spark):
    df = ordered(spark).repartition(7)
    for n in (0, 1, 33, 100, 500):
        assert {r.row_id for r in first_n(df, n, "row_id").collect()} == set(range(min(n, 100)))
    far = df.unionByName(
        spark.createDataFrame([(2**62, "far", 1), (-(2**61), "low", 0)], df.schema)
    )
    assert sorted(r.row_id for r in first_n(far, 11, "row_id").collect()) == [-(2**61), *range(10)]
    assert first_n(df.limit(0), 5, "row_id").count() == 0
    assert [r.text for r in first_n(df, 2, "text").orderBy("text").collect()] == ["t0", "t1"]


def test_seeded_cap_is_the_head_of_the_shuffle(spark):
    df = ordered(spark)
    shuffled = [r.row_id for r in seeded_shuffle(df, "row_id", 42).collect()]
    assert sorted(shuffled) == list(range(100)) and shuffled != sorted(shuffled)
    for parts in (1, 9):
        capped = seeded_cap(df.repartition(parts), 20, "row_id", 42)
        assert {r.row_id for r in capped.collect()} == set(shuffled[:20])
        assert capped.select("label").distinct().count() == 2
    assert shuffled != [r.row_id for r in seeded_shuffle(df, "row_id", 43).collect()]


def test_stratified_cap(spark):
    df = ordered(spark).withColumn("label", F.when(F.col("row_id") < 3, 1).otherwise(F.lit(None)))
    rows = seeded_cap(df, 5, "row_id", 1, strata=["label"]).collect()
    assert sorted(str(r.label) for r in rows) == ["1"] * 3 + ["None"] * 5
    keyed = df.where("label IS NULL").orderBy(shuffle_key("row_id", 1)).limit(5)
    expected = {r.row_id for r in keyed.collect()}
    assert {r.row_id for r in rows if r.label is None} == expected


def test_newest_n_with_equal_times(spark):
    df = spark.createDataFrame(
        [("a", 5, 1), ("a", 5, 2), ("a", 5, 3), ("a", 4, 4), ("b", 1, 5)],
        "community string, created_utc long, id long",
    )
    rows = newest_n(df, 2, "community", "created_utc", "id").collect()
    assert sorted(r.id for r in rows) == [1, 2, 5]


def test_newest_n_equals_a_sort(spark):
    df = spark.range(3_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(400)).alias("created"),
    )
    rows = df.collect()
    expected = set()
    for g in {r.g for r in rows}:
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (-r.created, r.id))
        expected |= {r.id for r in mine[:25]}
    found = newest_n(df.repartition(6), 25, "g", "created", "id")
    assert {r.id for r in found.collect()} == expected


def test_sample_rows(spark):
    rows = sample_rows(ordered(spark), "text", "label", "row_id", 2)
    assert rows.columns == ["text", "label"]
    assert [r.text for r in rows.collect()] == ["t0", "t1"]


def test_load_corpus(spark, tmp_path):
    spec = SPECS["sst2"]
    path = registry.corpus_path(str(tmp_path), spec)
    assert path.endswith("/sst2/sst2")
    rows = ordered(spark).withColumnRenamed("text", "sentence")
    both = rows.withColumn("split", F.lit("validation")).unionByName(
        rows.withColumn("split", F.lit("train"))
    )
    both.write.partitionBy("split").parquet(path)
    assert registry.load_corpus(spark, str(tmp_path), spec, None).count() == 100
    sample = registry.load_corpus(spark, str(tmp_path), spec, 20)
    assert sample.count() == 20
    assert {r.split for r in sample.collect()} == {"validation"}
    table = registry.read_corpus(spark, str(tmp_path), spec)
    head = registry.take_slice(table, "train[:7]", "row_id")
    assert sorted(r.row_id for r in head.collect()) == list(range(7))
    with pytest.raises(ValueError, match="Unsupported split slice"):
        registry.take_slice(table, "train[5:]", "row_id")


def post_table(spark, rows):
    return spark.createDataFrame(
        rows, "id string, title string, selftext string, created_utc long, community string"
    )


def test_collect_posts(spark):
    table = post_table(
        spark,
        [
            ("post123", "Great phone", "Battery lasts all day.", 1_700_000_000, "apple"),
            ("old", "Old", None, 1_600_000_000, "apple"),
            ("other", "x", None, 1_700_000_000, "spain"),
            ("skip", "x", None, 1_700_000_000, "cats"),
        ],
    )
    rows = posts.collect_posts(table, "en", limit_per_community=1).collect()
    assert len(rows) == 1
    row = rows[0]
    assert "Great phone" in row.text and row.lang == "en" and row.source == "reddit"
    assert (row.community, row.topic, row.post_id) == ("apple", "apple", "post123")
    assert row.timestamp.timestamp() == 1_700_000_000
    assert [r.topic for r in posts.collect_posts(table, "es").collect()] == ["general"]


def test_collect_posts_empty_and_errors(spark):
    empty = posts.collect_posts(post_table(spark, []), "en")
    assert empty.count() == 0
    assert empty.columns == ["text", "lang", "source", "topic", "community", "timestamp", "post_id"]
    with pytest.raises(ValueError, match="Unsupported language"):
        posts.collect_posts(post_table(spark, []), "fr")


def test_unknown_community_gets_the_default_topic(spark):
    df = spark.createDataFrame([("podemos",), ("cats",)], "community string")
    found = {r.community: r.topic for r in posts.with_topic(df).collect()}
    assert found == {"podemos": "politics", "cats": "general"}


def test_paths():
    assert corpora.raw_corpus_path("/data/", "en") == "/data/raw/lang=en"
    assert corpora.processed_corpus_path("/data", "es") == "/data/processed/study/lang=es"


def test_study_corpus(spark):
    df = spark.createDataFrame([("好 https://t.cn/x",), (" ",), (None,)], "review string")
    rows = corpora.study_corpus(df, "review").collect()
    assert [tuple(r) for r in rows] == [
        ("好", "zh", "weibo", "general", "weibo_senti_100k", None, "")
    ]


def test_training_set(spark):
    zh = ordered(spark).withColumnRenamed("text", "review")
    en = ordered(spark).withColumn("row_id", F.col("row_id") + 1_000)
    rows = corpora.training_set(
        (zh, "review", "label"), (en, "text", "label"), "row_id", en_rows=10, zh_rows=5
    )
    assert sorted(r.row_id for r in rows.collect()) == [*range(5), *range(1_000, 1_010)]
    assert rows.columns == ["row_id", "text", "label", "language"]


def test_training_set_comes_in_shuffled_order(spark):
    zh = ordered(spark).withColumnRenamed("text", "review")
    en = ordered(spark).withColumn("row_id", F.col("row_id") + 1_000)
    rows = corpora.training_set((zh, "review", "label"), (en, "text", "label"), "row_id")
    found = [r.row_id for r in rows.collect()]
    ids = spark.createDataFrame([(i,) for i in found], "row_id long")
    assert found == [r.row_id for r in seeded_shuffle(ids, "row_id", 42).collect()]
