import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentiweave.operators import langid
from sentiweave.operators.dedupe import duplicate_rate, keep_first
from sentiweave.operators.langid import LanguageProfiles, filter_language
from sentiweave.plans.prepare import preprocess, preprocess_job
from sentiweave.schema import CORPUS_SCHEMA
from sentiweave.sources.corpora import load_corpus_table, save_corpus_table, training_rows


def frame(spark, texts, **constants):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def test_keep_first(spark):
    df = frame(spark, ["Hello", "hello ", "other"])
    assert [r.text for r in keep_first(df).orderBy("id").collect()] == ["Hello", "other"]


def test_keep_first_ignores_partitioning_and_survives_a_hot_text(spark):
    df = spark.range(5_000).select(
        "id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")
    )
    expected = {0} | {i for i in range(5_000) if i % 3}
    for parts in (1, 7, 16):
        kept = keep_first(df.repartition(parts, F.rand(parts)))
        assert {r.id for r in kept.select("id").collect()} == expected


def test_hot_text_is_reduced_before_the_shuffle(spark):
    plan = keep_first(frame(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(
    ("texts", "rate"),
    [([], 0.0), (["a", "b", "c"], 0.0), (["a", "a", "b", "b", "b"], 0.6), ([" ", "A", "a "], 0.5)],
)
def test_duplicate_rate(spark, texts, rate):
    df = frame(spark, texts)
    assert duplicate_rate(df, "text").first().duplicate_rate == rate


def test_blank_rows_are_dropped(spark):
    df = frame(spark, ["valid post", "   ", "another", None], lang="en")
    kept = preprocess(df, "en", dedupe=False)
    assert [r.text for r in kept.orderBy("id").collect()] == ["valid post", "another"]


def test_dedupe_runs_on_clean_text_and_before_the_language_check(spark):
    english = "the weather is nice and the people are friendly in this old town"
    spanish = "el tiempo es bueno y la gente es amable en esta ciudad antigua"
    learn = frame(spark, [english, spanish]).withColumn(
        "lang", F.when(F.col("id") == 0, "en").otherwise("es")
    )
    profiles = LanguageProfiles.fit(learn, "text", "lang")
    df = frame(spark, [english, f"{english} https://x.y", spanish])
    kept = preprocess(df, "en", profiles=profiles)
    assert [r.id for r in kept.collect()] == [0]
    assert [r.id for r in filter_language(df, "es", profiles).collect()] == [2]


def test_base_language_is_compared(spark):
    learn = spark.createDataFrame(
        [("今天天气很好我们去公园", "zh-cn"), ("the weather is nice", "en")], "text string, lang string"
    )
    profiles = LanguageProfiles.fit(learn, "text", "lang")
    df = frame(spark, ["天气很好", "the nice", "", None])
    assert [r.text for r in filter_language(df, "zh", profiles).collect()] == ["天气很好"]


def test_detection_scores_whole_long_texts(spark, monkeypatch):
    from sentiweave.operators import langid

    learn = spark.createDataFrame(
        [("the weather is nice and warm", "en"), ("el tiempo es bueno y calido", "es")],
        "text string, lang string",
    )
    profiles = LanguageProfiles.fit(learn, "text", "lang")
    padded = " " + "the weather es bueno " * 50
    whole = profiles.score(padded)
    monkeypatch.setattr(langid, "_WINDOW", 7)
    assert (profiles.score(padded) == whole).all()


def test_corpus_round_trip_and_job(spark, tmp_path):
    rows = [
        ("hola  mundo", "es", "reddit", "general", "es", None, "a"),
        ("Hola mundo", "es", "reddit", "general", "es", None, "b"),
        ("hello", "en", "reddit", "apple", "apple", None, "c"),
    ]
    corpus = spark.createDataFrame(rows, CORPUS_SCHEMA).withColumn(
        "timestamp", F.timestamp_seconds(F.lit(1_704_067_200))
    )
    path = save_corpus_table(corpus, str(tmp_path / "raw" / "posts"))
    back = load_corpus_table(spark, path)
    assert back.schema == CORPUS_SCHEMA
    assert sorted(back.collect()) == sorted(corpus.collect())
    out = preprocess_job(spark, path, str(tmp_path / "clean"), "es")
    assert [(r.text, r.post_id) for r in load_corpus_table(spark, out).collect()] == [
        ("hola mundo", "a")
    ]


def test_training_rows(spark):
    df = spark.createDataFrame(
        [("好 该微博因被投诉违反社区公约", "pos"), ("  ", "pos"), ("x", "?"), ("坏", "neg")],
        "review string, label string",
    )
    rows = training_rows(df, "review", "label", "zh")
    assert rows.columns == ["text", "label", "language"]
    assert sorted((r.text, r.label) for r in rows.collect()) == [("坏", 0), ("好", 1)]


def test_row_wise_steps_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, ["a  b", " "], lang="en").write.parquet(source)
    stream = spark.readStream.schema("id long, text string, lang string").parquet(source)
    query = (
        preprocess(stream, F.col("lang"), dedupe=False)
        .writeStream.format("memory")
        .queryName("cleaned")
        .trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp"))
        .start()
    )
    query.awaitTermination(60)
    assert [r.text for r in spark.table("cleaned").collect()] == ["a b"]


def test_trigrams_are_counted_as_numbers(monkeypatch):
    texts = [(" ab c ", "x"), (" \U0001f600é\0 ", "x"), (" ab ", None), (" ab ab ", "y"), (" a ", "y"), (" abcabcabc ", "y")]
    wanted = {}
    for text, lang in texts:
        for i in range(len(text) - 2):
            wanted[lang, text[i : i + 3]] = wanted.get((lang, text[i : i + 3]), 0) + 1
    batches = [pa.RecordBatch.from_pylist([{"lang": b, "_padded": a} for a, b in part]) for part in (texts[:3], texts[3:])]
    for held, window in ((1 << 20, 1 << 20), (1, 4), (1 << 20, 5)):
        monkeypatch.setattr(langid, "_HELD_COUNTS", held)
        monkeypatch.setattr(langid, "_WINDOW", window)
        found = {}
        for row in (row for out in langid._gram_counts(iter(batches)) for row in out.to_pylist()):
            found[row["lang"], row["gram"]] = found.get((row["lang"], row["gram"]), 0) + row["n"]
        assert found == {k: n for k, n in wanted.items() if k[0]}


def test_dense_and_sorted_lookups_agree(monkeypatch):
    rng = np.random.default_rng(6)
    codes = np.unique([langid._codes(rng.integers(97, 103, 3))[0] for _ in range(60)])
    weights = rng.integers(-900, -10, (len(codes), 3))
    texts = ["".join(chr(c) for c in rng.integers(96, 105, n)) for n in (0, 1, 2, 3, 40, 500)] + ["\U0010ffff中文"]
    dense = langid.LanguageProfiles(("a", "b", "c"), codes, weights, -1900)
    assert dense._dense is not None
    monkeypatch.setattr(langid, "_DENSE", 10)
    other = langid.LanguageProfiles(("a", "b", "c"), codes, weights, -1900)
    assert other._dense is None
    assert all(np.array_equal(a, b) for a, b in zip(dense._sums(texts), other._sums(texts)))
    assert dense.best(texts, 0.0) == other.best(texts, 0.0)
