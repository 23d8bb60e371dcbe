"""Atomic tables and collection as posts arrive."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sentiweave.plans.collect import POST_SCHEMA, NewestPosts, collect_arrivals, first_deliveries, one_of_each_post
from sentiweave.operators import quality
from sentiweave.sources import corpora, registry, splits
from sentiweave.sources.snapshots import SnapshotTable, read_table


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_keys_and_expiry(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no table"):
        table.read()
    assert table.replace(spark.range(3).withColumn("k", F.lit("a")), "a") == 1
    assert table.replace(spark.range(5, 7).withColumn("k", F.lit("b")), "b") == 2
    assert ids(table.read()) == [0, 1, 2, 5, 6]
    assert table.replace(spark.range(9, 10).withColumn("k", F.lit("a")), "a") == 3
    assert ids(table.read()) == [5, 6, 9] and ids(table.read(1)) == [0, 1, 2]
    table.remove("b")
    assert ids(table.read()) == [9]
    table.overwrite(table.read().unionByName(spark.range(20, 21).withColumn("k", F.lit("c"))))  # reads itself
    assert ids(table.read()) == [9, 20]
    gone = table.expire(1)
    assert len(gone) == 3 and table.versions() == [5] and ids(table.read()) == [9, 20]
    with pytest.raises(ValueError, match="isn't there"):
        table.read(2)


def test_partitions_with_odd_names_and_pruning(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "a/b"), (2, None), (3, "x=y"), (4, "plain")], "id long, lang string")
    table.replace_partitions(rows, "lang")
    assert sorted(map(str, table.read().collect())) == sorted(map(str, rows.collect()))
    table.replace_partitions(spark.createDataFrame([(7, "plain")], rows.schema), "lang")
    assert ids(table.read()) == [1, 2, 3, 7]
    plan = table.read().where("lang = 'plain'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def test_a_write_that_dies_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    corpora.save_predictions(spark.range(4), path)

    @F.udf("long")
    def broken(x):
        if x == 3:
            raise RuntimeError("lost")
        return x

    with pytest.raises(Exception, match="lost"):
        corpora.save_predictions(spark.range(4).select(broken("id").alias("id")), path)
    assert ids(read_table(spark, path)) == [0, 1, 2, 3]
    assert len(SnapshotTable(spark, path).expire(1)) == 1  # what the dead write left


def test_writers_that_commit_at_once_are_put_in_a_row(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda i: SnapshotTable(spark, path).replace(spark.range(i, i + 1), f"run={i}"), range(8)))
    assert sorted(found) == list(range(1, 9))
    assert ids(SnapshotTable(spark, path).read()) == list(range(8))


def test_a_repeated_run_adds_no_metrics(spark, tmp_path):
    path = str(tmp_path / "m")
    values = spark.createDataFrame([("f1", 0.5), ("acc", 0.6)], "metric string, value double")
    for run, scope in (("a", "en"), ("a", "fr"), ("b", "en"), ("a", "en")):
        corpora.append_metrics(values, path, run, scope)
    assert read_table(spark, path).count() == 6
    corpora.append_metrics(values.limit(1), path, "a", "en")
    assert read_table(spark, path).where("run = 'a' and scope = 'en'").count() == 1


def test_plain_tables_are_read_too(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "plain"))
    assert ids(read_table(spark, str(tmp_path / "plain"))) == [0, 1]


def posts(rng, n):
    names = ["apple", "apple", "apple", "technology", "ChatGPT", "elsewhere"]
    rows = [(f"p{i:04}", f"title {i}", rng.choice([None, "body"]), rng.randrange(500), rng.choice(names)) for i in range(n)]
    return [*rows, (None, "no id", None, 499, "apple"), ("undated", "t", None, None, "apple")]


def newest(rows, limit):
    found = []
    for name in ("apple", "technology", "ChatGPT"):
        own = sorted((r for r in rows if r[4] == name), key=lambda r: (r[3] is None, -(r[3] or 0), r[0] is None, r[0] or ""))
        found += own[:limit]
    return sorted(map(str, found))


@pytest.mark.parametrize("seed", [1, 2])
def test_arrivals_in_any_order_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = posts(rng, 300)
    landed = str(tmp_path / "landed")
    order = rows + rng.sample([r for r in rows if r[0]], 60)  # some are delivered twice
    rng.shuffle(order)
    third = len(order) // 3
    for i in range(3):  # each call takes what has arrived since the last one, a file at a time
        part = spark.createDataFrame(order[i * third :] if i == 2 else order[i * third : (i + 1) * third], POST_SCHEMA)
        part.repartition(2).write.mode("append").parquet(landed)
        held = collect_arrivals(spark, landed, str(tmp_path / "root"), "en", 25, files_per_batch=1)
    assert sorted(str(tuple(r)) for r in held.posts().collect()) == newest(rows, 25)
    raw = corpora.load_corpus_table(spark, corpora.raw_corpus_path(str(tmp_path / "root"), "en"))
    assert raw.count() == len(newest(rows, 25)) and {r.lang for r in raw.collect()} == {"en"}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = posts(random.Random(4), 80)
    held = NewestPosts(spark, str(tmp_path), "en", 10)
    some, rest = (spark.createDataFrame(x, POST_SCHEMA) for x in (rows[:50], rows[50:]))
    for batch in (some, some, rest, rest, some):
        held.take(batch.where("id is not null"))
    assert sorted(str(tuple(r)) for r in held.posts().collect()) == newest([r for r in rows if r[0]], 10)
    with pytest.raises(ValueError, match="Unsupported language"):
        NewestPosts(spark, str(tmp_path), "xx", 10)


def test_one_of_each_post(spark):
    rows = [("a", "old", None, 1, "x"), ("a", "new", "b", 2, "x"), ("a", "other", None, 9, "y"), (None, "n", None, 1, "x"), (None, "n", None, 1, "x")]
    found = sorted(tuple(r)[1] for r in one_of_each_post(spark.createDataFrame(rows, POST_SCHEMA)).collect())
    assert found == ["n", "n", "new", "other"]


def test_first_deliveries_within_the_delay(spark, tmp_path):
    rows = [(f"p{i % 40}", "t", None, 1_000 + i, "apple") for i in range(120)]
    spark.createDataFrame(rows, POST_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_deliveries(spark.readStream.schema(POST_SCHEMA).parquet(str(tmp_path / "in")), "1 hour")
    query = stream.writeStream.format("memory").queryName("first_deliveries").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r.id for r in spark.table("first_deliveries").collect()) == sorted({r[0] for r in rows})


def opened(df):
    return sorted(f.rsplit("/", 1)[-1] for f in df.inputFiles())


@pytest.mark.parametrize("indexed", [True, False])
def test_a_head_opens_its_own_files_alone(spark, tmp_path, indexed):
    path = str(tmp_path / "c")
    rows = spark.range(1_000).select(F.col("id").alias("row_id"), F.lit("t").alias("text")).repartition(5)
    folder = splits.write_split(rows, path, "train", "row_id", 100)
    if not indexed:
        rows.repartitionByRange(8, "row_id").write.parquet(f"{path}/split=landed")
        folder = f"{path}/split=landed"
    name = folder.rsplit("=", 1)[-1]
    whole = splits.read_slice(spark, path, name, "row_id")
    assert whole.count() == 1_000
    every = opened(whole)
    for n in (0, 1, 150, 1_000, 5_000):
        head = splits.read_slice(spark, path, f"{name}[:{n}]", "row_id")
        assert sorted(r.row_id for r in head.collect()) == list(range(min(n, 1_000)))
        assert {r.split for r in head.collect()} <= {name}
    head = splits.read_slice(spark, path, f"{name}[:150]", "row_id")
    assert 0 < len(opened(head)) < len(every)
    if indexed:  # what lies beyond isn't even there any more
        for file in set(every) - set(opened(head)):
            (tmp_path / "c" / "split=train" / file).write_bytes(b"broken")
        assert splits.read_slice(spark, path, "train[:150]", "row_id").count() == 150


def test_heads_of_splits_with_null_and_equal_ids(spark, tmp_path):
    ids = [None] * 30 + [5] * 40 + list(range(6, 40))
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "row_id long, text string")
    splits.write_split(rows, str(tmp_path), "train", "row_id", 10)
    for n in (10, 40, 60, 90, 104):
        head = splits.read_slice(spark, str(tmp_path), f"train[:{n}]", "row_id").collect()
        expected = sorted(ids, key=lambda i: (i is None, i or 0))[:n]
        assert sorted((r.row_id is None, r.row_id or 0) for r in head) == [(i is None, i or 0) for i in expected]


def test_registry_slices_open_few_files(spark, tmp_path):
    spec = next(s for s in registry.CORPORA if s.name == "sentiment140")
    rows = spark.range(300).select(F.col("id").alias("row_id"), F.lit("a b").alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    splits.write_split(rows, registry.corpus_path(str(tmp_path), spec), "train", "row_id", 30)
    head = registry.read_corpus_slice(spark, str(tmp_path), spec, "train[:50]")
    assert head.count() == 50 and len(opened(head)) <= 3
    with pytest.raises(ValueError, match="Unsupported split slice"):
        registry.read_corpus_slice(spark, str(tmp_path), spec, "train[5:]")


def test_checked_write_counts_in_its_own_pass(spark, tmp_path):
    rows = [(1, "a", "7"), (0, " ", "8"), (5, "b", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "label int, text string, number string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(x):
        read.add(1)
        return x

    df = df.withColumn("label", seen("label"))
    rules = {"label": quality.in_range("label", 0, 1), "text": quality.present("text"), "number": quality.parses("number", "int")}
    path = str(tmp_path / "t")
    counts = quality.write_checked(df, path, rules)
    assert counts == {"rows": 4, "rejected": 3, "label": 2, "text": 2, "number": 1}
    assert read.value == 4  # one pass
    assert [r.text for r in quality.accepted(spark, path).collect()] == ["a"]
    apart = quality.rejected(spark, path, list(rules))
    assert apart.columns == [*df.columns, "broken_rules"]
    assert sorted(r.broken_rules for r in apart.collect()) == [["label", "number"], ["label", "text"], ["text"]]
    assert quality.write_checked(df.limit(0), path, rules)["rows"] == 0
    assert quality.accepted(spark, path).count() == 0
    with pytest.raises(ValueError, match="rules are needed"):
        quality.write_checked(df, path, {})
