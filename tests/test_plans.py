import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sentiweave.functions.text import NWS, Tokenizer
from sentiweave.plans import report, scoring, studies, training
from sentiweave.plans.collect import collect_job
from sentiweave.plans.prepare import preprocess_job
from sentiweave.schema import CORPUS_SCHEMA
from sentiweave.sources.snapshots import read_table
from sentiweave.sources.corpora import (
    load_corpus_table,
    processed_table,
    raw_table,
    save_corpus_table,
)
from sentiweave.sources.registry import CorpusSpec

OPTIONS = training.TrainingOptions(features=1 << 10, max_iterations=5)


@pytest.fixture(scope="module")
def labelled(spark):
    words = F.when(F.col("id") % 2 == 1, "great lovely good").otherwise("awful bad sad")
    return spark.range(80).select(
        "id",
        F.concat(words, F.lit(" item "), F.col("id")).alias("text"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 4 < 2, "zh").otherwise("en").alias("language"),
    )


def test_train_score_evaluate(spark, labelled, tmp_path):
    best = training.train_job(labelled, labelled, str(tmp_path), "smoke", OPTIONS, "id")
    model = PipelineModel.load(best)
    logged = read_table(spark, f"{tmp_path}/metrics")
    values = {r.metric: r.value for r in logged.collect()}
    assert values["train_rows"] == 80.0
    assert values["val_zh_eval_f1"] == 1.0 and values["val_en_eval_accuracy"] == 1.0
    assert {r.run for r in logged.collect()} == {"smoke"}
    corpus = labelled.select("id", "text", F.lit("en").alias("lang"), F.lit("t").alias("topic"))
    scored = scoring.predict_corpus(corpus, scoring.model_scorer(model))
    assert scored.columns == [
        *corpus.columns, "sentiment_label", "sentiment_score", "confidence",
    ]
    assert scored.where("sentiment_label <> id % 2").count() == 0
    assert scored.where("confidence < 0.5 OR sentiment_score NOT BETWEEN 0 AND 1").count() == 0


def test_model_selection(labelled):
    options = training.TrainingOptions(
        features=1 << 10, max_iterations=3, regularization=(0.01, 100.0)
    )
    model = training.fit_classifier(labelled, options, "id")
    assert model.stages[-1].getRegParam() == 0.01


def test_swapped_scorer(spark):
    df = spark.createDataFrame(
        [("good", "en", "t"), ("bad", "en", "t")], "text string, lang string, topic string"
    )

    def load():
        return lambda texts: [[0.1, 0.9] if t == "good" else [0.85, 0.15] for t in texts]

    rows = scoring.predict_corpus(df, scoring.external_scorer(load, batch_size=1)).collect()
    assert [(r.sentiment_label, r.sentiment_score, r.confidence) for r in rows] == [
        (1, 0.9, 0.9),
        (0, 0.15, 0.85),
    ]
    with pytest.raises(ValueError, match="Missing columns"):
        scoring.predict_corpus(df.drop("topic"), scoring.external_scorer(load))


def test_predict_job(spark, tmp_path):
    row = ("good", "en", "reddit", "t", "c", None, "1")
    path = save_corpus_table(spark.createDataFrame([row], CORPUS_SCHEMA), str(tmp_path / "in"))
    scorer = lambda df: df.withColumn("probabilities", F.array(F.lit(0.2), F.lit(0.8)))
    out = scoring.predict_job(spark, path, str(tmp_path / "out"), scorer)
    assert read_table(spark, out).first().sentiment_label == 1
    empty = save_corpus_table(
        spark.createDataFrame([row], CORPUS_SCHEMA).where("lang = 'xx'"), str(tmp_path / "none")
    )
    with pytest.raises(ValueError, match="No rows to score"):
        scoring.predict_job(spark, empty, str(tmp_path / "out2"), scorer)


def test_collect_prepare_train_score(spark, labelled, tmp_path):
    """The jobs one after the other, each reading what the one before wrote."""
    root, landed = str(tmp_path), str(tmp_path / "landed")
    posts = labelled.select(
        F.col("id").cast("string").alias("id"),
        F.col("text").alias("title"),
        F.lit("the same  body https://x.y").alias("selftext"),
        (F.col("id") + 1_700_000_000).alias("created_utc"),
        F.when(F.col("id") < 40, "apple").otherwise("technology").alias("community"),
    )
    posts.unionByName(posts.withColumn("id", F.concat("id", F.lit("x")))).write.parquet(landed)
    spanish = spark.createDataFrame([("hola", "es", "s", "t", "c", None, "1")], CORPUS_SCHEMA)
    save_corpus_table(spanish, raw_table(root))
    raw = collect_job(spark, landed, root, "en", limit_per_community=30)
    collected = load_corpus_table(spark, raw)
    assert {r.lang: r["count"] for r in collected.groupBy("lang").count().collect()} == {
        "en": 60, "es": 1,
    }
    clean = preprocess_job(spark, raw, processed_table(root), "en")
    assert load_corpus_table(spark, clean).count() == 30
    best = training.train_job(labelled, labelled, f"{root}/model", "run", OPTIONS, "id")
    scorer = scoring.model_scorer(PipelineModel.load(best))
    out = read_table(spark, scoring.predict_job(spark, clean, f"{root}/predictions", scorer))
    assert out.count() == 30
    wrong = (F.col("sentiment_label") == 1) != F.col("text").contains("lovely")
    assert out.where(wrong).count() == 0


def test_report(spark, labelled):
    spec = CorpusSpec(
        "a", "a", "train", "en", "text", "label", dataset_id="local/a", id_column="id"
    )
    tables = report.corpus_report({"a": (spec, labelled)})
    assert tables["summary"].first().n_rows == 80
    assert tables["label_distribution"].count() == 2
    assert tables["length_histogram"].agg(F.sum("count")).first()[0] == 80
    assert tables["tokens_a"].first().token_sample_size == 80
    assert tables["sample_a"].count() == 3
    assert tables["word_boxplot"].count() == tables["char_boxplot"].count() == 1
    assert tables["flags"].count() == 0


def test_aspects(spark):
    df = spark.createDataFrame(
        [("The Price is high", "en", 0.2), ("privacy, price!", "en", 0.6), ("precio", "es", 0.9)],
        "text string, lang string, sentiment_score double",
    )
    terms = {"price": ["price", "precio"], "privacy": ["privacy"]}
    tagged = df.withColumn("aspects", studies.tag_aspects(F.col("text"), terms))
    found = studies.aspect_sentiment(tagged, ["price"]).collect()
    assert {(r.aspect, r.lang, round(r.mean_score, 9)) for r in found} == {
        ("price", "en", 0.4),
        ("price", "es", 0.9),
    }


def test_translation_gap_and_gold(spark):
    native = spark.createDataFrame(
        [(1, "es", 0.9), (2, "es", 0.5)], "post_id int, lang string, sentiment_score double"
    )
    other = spark.createDataFrame([(1, 0.4), (3, 0.0)], "post_id int, sentiment_score double")
    row = studies.translation_gap(native, other).first()
    assert (row.lang, round(row.gap, 9), row.n_posts) == ("es", 0.5, 1)
    gold = native.select("post_id", "lang", F.lit(1).alias("label"))
    guess = native.select("post_id", (F.col("post_id") - 1).alias("sentiment_label"))
    assert studies.gold_accuracy(guess, gold, ["lang"]).first().accuracy == 0.5


def test_boundary_agreement(spark):
    df = spark.createDataFrame([("zh", "ab cde"), ("zh", ""), ("zh", None)], "lang string, text string")
    pairs = Tokenizer(
        split=lambda c: F.regexp_extract_all(F.replace(c, F.lit(" ")), F.lit(".{1,2}"), F.lit(0)),
        join=lambda a: F.array_join(a, ""),
    )
    row = studies.boundary_agreement(df, "text", ["lang"], pairs).first()
    assert (row.n_word_ends, row.n_shared_ends, row.boundary_agreement) == (2, 2, 1.0)
    threes = Tokenizer(
        split=lambda c: F.regexp_extract_all(F.replace(c, F.lit(" ")), F.lit(".{1,3}"), F.lit(0)),
        join=pairs.join,
    )
    assert studies.boundary_agreement(df, "text", ["lang"], threes).first().n_shared_ends == 1


def test_tokenized(spark):
    df = spark.createDataFrame([("a b a c", 1), ("", 0)], "text string, label int")
    rows = training.tokenized(df, limit=3, vocabulary=50)
    assert rows.columns == ["input_ids", "attention_mask", "labels"]
    first, second = rows.collect()
    assert first.input_ids[0] == first.input_ids[2] and len(first.input_ids) == 3
    assert all(0 <= i < 50 for i in first.input_ids)
    assert first.attention_mask == [1, 1, 1] and second.input_ids == []


def test_temperature(spark):
    # Three of four rows with logit gap 4 are right: the best T makes the share 0.75.
    rows = [("en", [0.0, 4.0], 1)] * 3 + [("en", [0.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "lang string, logits array<double>, label int")
    best = studies.fit_temperature(df, "logits", "label", ["lang"]).first()
    assert best.temperature == pytest.approx(4 / 1.0986, rel=0.01)
    rough = studies.fit_temperature(df, "logits", "label", ["lang"], refine=False).first()
    assert rough.nll >= best.nll


def test_fragmentation(spark):
    df = spark.createDataFrame([("en", "abcd abcdef ab")], "lang string, text string")
    pieces = Tokenizer(
        split=lambda c: F.regexp_extract_all(c, F.lit(f"({NWS}{{1,4}})")),
        join=lambda a: F.array_join(a, ""),
    )
    row = studies.token_fragmentation(df, "text", ["lang"], pieces).first()
    assert (row.n_words, row.n_subwords, row.max_subwords) == (3, 4, 2)
    assert row.fragmentation_rate == pytest.approx(1 / 3)


def test_word_ends_are_compared_some_texts_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [([int(x) for x in rng.integers(1, 6, n)], [int(x) for x in rng.integers(1, 6, m)]) for n, m in rng.integers(0, 30, (200, 2))]
    rows += [([], []), ([3], []), ([], [2]), ([5] * 900, [1] * 4500)]
    words, pieces = (pa.array(side, pa.list_(pa.int32())) for side in zip(*rows))
    wanted = [{"words": len(a), "hits": len(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))} for a, b in rows]
    sizes, hits = [], studies._hits
    monkeypatch.setattr(studies, "_TOKENS", 100)
    monkeypatch.setattr(studies, "_hits", lambda a, b: sizes.append(len(a.flatten()) + len(b.flatten())) or hits(a, b))
    assert studies._word_ends_hit.func(words, pieces).to_pylist() == wanted
    assert max(sizes[:-1]) <= 100 and sizes[-1] == 5400
    assert studies._word_ends_hit.func(words[:0], pieces[:0]).to_pylist() == []
