"""Cases that once went wrong: null and equal keys, unknown languages, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiweave.operators import langid, metrics, profile
from sentiweave.operators.dedupe import keep_first
from sentiweave.operators.ranktest import exact_p
from sentiweave.operators.sampling import first_n, newest_n, seeded_cap
from sentiweave.plans import collect, scoring, studies, training
from sentiweave.session import build_session
from sentiweave.sources import corpora
from sentiweave.sources.registry import CORPORA, corpus_path


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


def test_newest_of_undated_and_far_posts(spark):
    rows = [("a", None, 1), ("b", 5.0, 2), ("a", 3.0, 3), ("b", float("nan"), 4), ("a", 1e18, 5), ("a", 3.0, 0)]
    posts = spark.createDataFrame(rows, "community string, created double, id long")
    take = lambda n: sorted((r[0], r[2]) for r in newest_n(posts, n, "community", "created", "id").collect())
    assert take(1) == [("a", 5), ("b", 2)]
    assert take(2) == [("a", 0), ("a", 5), ("b", 2), ("b", 4)]
    assert take(4) == sorted((r[0], r[2]) for r in rows)


def test_first_of_null_and_equal_ids(spark):
    some = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "id long, text string")
    assert {r.text for r in first_n(some, 2, "id").collect()} == {"a", "b"}
    equal = spark.createDataFrame([("", f"t{i}") for i in range(20)] + [("", "twice")] * 5, "id string, text string")
    assert first_n(equal, 3, "id").count() == 3
    assert first_n(equal, 22, "id").count() == 22
    assert first_n(spark.createDataFrame([("", "same")] * 9, equal.schema), 4, "id").count() == 4


@pytest.mark.parametrize("n", [1, 7, 1_500])
def test_newest_equals_a_sort(spark, n):
    rng = random.Random(1)
    times = lambda: rng.choice([None, 7, 7, 7, 7, rng.randrange(100), 10**12])
    rows = [(f"g{rng.randrange(3)}", times(), f"post_{rng.randrange(3_000):05d}", i) for i in range(6_000)]
    posts = spark.createDataFrame(rows, "community string, created long, id string, k long")
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    got = newest_n(posts, n, "community", "created", "id").collect()
    for name in ("g0", "g1", "g2"):
        own = sorted(key(r) for r in rows if r[0] == name)
        assert sorted(key(r) for r in got if r[0] == name) == own[:n]
    assert sorted(r.id for r in first_n(posts, n, "id").collect()) == sorted(r[2] for r in rows)[:n]


def test_selected_rows_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for found in (
        newest_n(docs, 5, "source", "n_chars", "doc_id"),
        seeded_cap(docs, 5, "doc_id", 1, ["lang"]),
        first_n(docs, 50, "doc_id"),
    ):
        assert exchanges(found) == []


def test_copies_are_dropped_without_shuffling_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = keep_first(docs, "text", "doc_id").groupBy("lang").count()
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.split("\n") if "Window [" in line)
    assert "text" not in window
    below = plan.split("Window [")[1].split("\n")[1]
    assert "text#" not in below.split("AS")[0]


def test_languages_that_nothing_is_known_of(spark):
    known = [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 3
    profiles = langid.language_profiles(spark.createDataFrame(known, "text string, lang string"), "text", "lang")
    texts = ["12345 67890", "这个手机", "привет мир", "🎉🎉🎉🎉", "the dog", "die katze", "", None, "xqz the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    fitted = langid.LanguageProfiles.from_table(profiles)
    got = {r.id: r.found for r in df.select("id", fitted.detect(F.col("text")).alias("found")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "en", 5: "de", 6: None, 7: None, 8: "en"}
    joined = {r.id: r.detected for r in langid.detect_by_join(df, "text", profiles, "id").collect()}
    assert joined == got
    strict = df.select("id", fitted.detect(F.col("text"), min_known=0.9).alias("found"))
    assert {r.id for r in strict.where("found is not null").collect()} == {4, 5}
    assert langid.filter_language(df, "de", fitted).count() == 1


def test_profiles_of_any_size(spark, monkeypatch):
    """More trigrams than were once allowed, over texts longer than a window."""
    rng = random.Random(3)
    letters = {"aa": range(0x4E00, 0x4E60), "bb": range(0x5E00, 0x5E60)}
    texts = [("".join(chr(rng.choice(codes)) for _ in range(60_000)), lang) for lang, codes in letters.items() for _ in range(3)]
    df = spark.createDataFrame(texts, "text string, lang string")
    fitted = langid.LanguageProfiles.fit(df, "text", "lang")
    assert len(fitted.codes) > 200_000
    monkeypatch.setattr(langid, "_WINDOW", 1_000)
    whole = fitted.best([f" {t} " for t, _ in texts], 0.0)
    assert whole == [lang for _, lang in texts]
    assert np.array_equal(fitted.score(texts[0][0]), fitted._sums([texts[0][0]])[0][0])


OPTIONS = training.TrainingOptions(features=1 << 10, max_iterations=5)


def test_scoring_null_texts_and_clashing_columns(spark):
    rows = [("lovely", 1), ("awful", 0), (None, 0)] * 20
    model = training.fit_classifier(spark.createDataFrame(rows, "text string, label int"), OPTIONS)
    df = spark.createDataFrame([("keep me", "lovely", "en", "t"), ("keep", None, "en", "t")], "text string, body string, lang string, topic string")
    out = scoring.predict_corpus(df, scoring.model_scorer(model, "body"), "body").collect()
    assert [(r.text, r.body) for r in out] == [("keep me", "lovely"), ("keep", None)]
    assert out[0].sentiment_label == 1 and out[1].sentiment_label == 0


def test_empty_collection_empties_the_language(spark, tmp_path):
    schema = "id string, title string, selftext string, created_utc long, community string"
    posts = spark.createDataFrame([("1", "t", "b", 5, "apple"), ("2", "t", "b", 6, "spain")], schema)
    for name, rows in (("full", posts), ("none", posts.where("community = 'spain'"))):
        rows.write.parquet(f"{tmp_path}/{name}")
    root = str(tmp_path / "root")
    for language in ("en", "es"):
        collect.collect_job(spark, f"{tmp_path}/full", root, language)
    table = lambda: corpora.load_corpus_table(spark, corpora.raw_table(root))
    assert sorted(r.lang for r in table().collect()) == ["en", "es"]
    collect.collect_job(spark, f"{tmp_path}/none", root, "en")
    assert [r.lang for r in table().collect()] == ["es"]


def test_missing_values_are_violations(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (None, 1.5, None)], "sentiment_label int, sentiment_score double, confidence double")
    assert {r.rule: r.violations for r in metrics.range_violations(df).collect()} == {
        "sentiment_label": 1, "sentiment_score": 1, "confidence": 1,
    }
    rows = spark.createDataFrame([("t", None, "s", None)], "text string, lang string, source string, topic string")
    assert {r.column: r.missing for r in metrics.missing_values(rows).collect()} == {"text": 0, "lang": 1, "source": 0, "topic": 1}


def test_audit_goes_on_past_a_source_that_cannot_be_read(spark):
    good = spark.createDataFrame([("a",)], "text string")
    found = metrics.audit_sources({"good": (good, ["text"]), "bad": (lambda: spark.read.parquet("/nowhere/at/all"), ["text"])})
    assert {r.source: (r.n_rows, r.ok) for r in found.collect()} == {"good": (1, True), "bad": (0, False)}


def test_exact_p_has_no_size_switch():
    assert exact_p(0, 1, 2_000_000) == pytest.approx(2 / 2_000_001)
    assert exact_p(0, 1, 2_000_001) == pytest.approx(2 / 2_000_002)
    assert exact_p(0, 8, 10**7) == pytest.approx(2 / __import__("math").comb(10**7 + 8, 8), rel=1e-9)


def test_boolean_labels_and_unregistered_corpora(spark):
    frame = profile.eda_frame(spark.createDataFrame([("a", True), ("b", None)], "text string, label boolean"), "text", "label", "en")
    assert [r.label for r in frame.orderBy("text").collect()] == ["True", "None"]


def test_aspects_in_a_script_without_spaces(spark):
    df = spark.createDataFrame([("这个手机的价格太高了",), ("the price",), ("prices",)], "text string")
    tags = df.select(studies.tag_aspects(F.col("text"), {"price": ["price", "价格"]}).alias("tags")).collect()
    assert [r.tags for r in tags] == [["price"], ["price"], []]


def test_registry_loaders(spark, tmp_path):
    for spec in CORPORA:
        rows = [(i, f"{spec.name} text {i}", i % 2) for i in range(20)]
        columns = f"row_id long, {spec.text_column} string, {spec.label_column} int"
        spark.createDataFrame(rows, columns).withColumn("split", F.lit(spec.split)).write.partitionBy("split").parquet(
            corpus_path(str(tmp_path), spec)
        )
    root = str(tmp_path)
    train = corpora.load_training_set(spark, root, en_rows=5)
    assert {r.language: r["count"] for r in train.groupBy("language").count().collect()} == {"zh": 20, "en": 5}
    assert train.where("text like 'sentiment140 text%'").count() == 5
    validation = corpora.load_validation_set(spark, root).groupBy("language").count().collect()
    assert {r.language: r["count"] for r in validation} == {"zh": 20, "en": 20}
    study = corpora.load_study_corpus(spark, root, max_rows=7)
    assert sorted(r.post_id for r in study.collect()) == sorted(map(str, range(7)))


def test_initial_partitions_are_a_parameter(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    build_session(initial_partitions=64)
    assert spark.conf.get(name) == "64"
    spark.conf.unset(name)
