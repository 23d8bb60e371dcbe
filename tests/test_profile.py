import math
import random

import pytest
from pyspark.sql import functions as F

from sentiweave.operators import histogram, profile
from sentiweave.sources.registry import CorpusSpec, registry_frame


def labelled(spark, rows, kind="int"):
    return spark.createDataFrame(rows, f"text string, label {kind}")


def test_eda_frame(spark):
    df = labelled(spark, [("hello world", 1), ("短文本", 0), (None, None)])
    eda = profile.eda_frame(df, "text", "label", "en")
    assert eda.columns == ["text", "label", "char_len", "word_len", "language"]
    assert [tuple(r) for r in eda.collect()] == [
        ("hello world", "1", 11, 2, "en"),
        ("短文本", "0", 3, 1, "en"),
        ("", "None", 0, 0, "en"),
    ]


def test_missing_column(spark):
    df = labelled(spark, [("a", 1)])
    with pytest.raises(ValueError, match="Missing columns"):
        profile.eda_frame(df, "missing", "label", "en")
    with pytest.raises(ValueError, match="Missing columns"):
        profile.corpus_profile(df, "text", "missing")


def test_label_distribution(spark):
    eda = profile.eda_frame(labelled(spark, [("a", 0), ("b", 1), ("c", 1)]), "text", "label", "en")
    assert [tuple(r) for r in profile.label_distribution(eda).collect()] == [
        ("1", 2, 0.6667, 66.7),
        ("0", 1, 0.3333, 33.3),
    ]


def test_mixed_label_types_stack(spark):
    numbers = profile.eda_frame(labelled(spark, [("a", 1)]), "text", "label", "zh")
    words = profile.eda_frame(
        labelled(spark, [("b", "negative")], "string"), "text", "label", "en"
    )
    stacked = profile.stack_corpora({"x": numbers, "y": words})
    assert sorted((r.corpus, r.label) for r in stacked.collect()) == [("x", "1"), ("y", "negative")]


def test_summary(spark):
    df = labelled(spark, [("a" * 300, 1), ("b" * 50, 0), ("c" * 20, 1)])
    row = profile.summarize_corpora(profile.eda_frame(df, "text", "label", "en")).first()
    assert row.is_binary
    assert row.positive_ratio == 0.6667
    assert row.label_skew == 0.1667
    assert row.pct_over_char_threshold == 33.33
    assert row.label_counts == {"0": 1, "1": 2}
    assert (row.char_len_mean, row.char_len_p50, row.char_len_max) == (123.3, 50.0, 300)
    assert len(row) == 21


@pytest.mark.parametrize(("language", "metric"), [("zh", "char_len"), ("en", "word_len")])
def test_primary_length(spark, language, metric):
    df = labelled(spark, [("one two", 1)])
    row = profile.summarize_corpora(profile.eda_frame(df, "text", "label", language)).first()
    assert row.primary_length_metric == metric
    assert row.primary_len_p95 == (7.0 if language == "zh" else 2.0)


def test_summary_of_blanks_and_nothing(spark):
    df = labelled(spark, [(" ", 1), (None, 0), ("x", 0), ("X ", 1)])
    row = profile.summarize_corpora(profile.eda_frame(df, "text", "label", "en")).first()
    assert (row.empty_texts, row.duplicate_rate) == (2, 0.5)
    empty = profile.eda_frame(df.limit(0), "text", "label", "en")
    assert profile.summarize_corpora(empty).count() == 0


def test_summary_equals_python(spark):
    rng = random.Random(7)
    rows = [
        ("".join(rng.choice("ab \n短") for _ in range(rng.randrange(12))), rng.choice("01"))
        for _ in range(400)
    ]
    eda = profile.eda_frame(labelled(spark, rows, "string"), "text", "label", "zh")
    row = profile.summarize_corpora(eda.repartition(5)).first()
    texts = [t for t, _ in rows]
    keys = [t.strip().lower() for t in texts if t.strip()]
    chars, words = sorted(map(len, texts)), sorted(len(t.split()) for t in texts)

    def at(values, q):
        return float(values[min(len(values) - 1, int(q * (len(values) - 1)))])

    assert row.n_rows == 400
    assert row.duplicate_rate == pytest.approx((len(keys) - len(set(keys))) / len(keys), abs=5e-5)
    assert row.empty_texts == sum(not t.strip() for t in texts)
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95")):
        assert row[f"char_len_{name}"] == at(chars, q)
        assert row[f"word_len_{name}"] == at(words, q)
    assert row.char_len_mean == pytest.approx(sum(chars) / 400, abs=0.051)


def test_summary_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "in")
    labelled(spark, [("a", 1), ("b", 0)]).write.parquet(path)
    eda = profile.eda_frame(spark.read.parquet(path), "text", "label", "en")
    plan = profile.summarize_corpora(eda)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_summary_rows_and_flags(spark):
    df = labelled(spark, [("one two three", 1), ("four five", 0)])
    eda = profile.stack_corpora({"tiny": profile.eda_frame(df, "text", "label", "en")})
    summary = profile.summarize_corpora(eda, ["corpus", "language"])
    spec = CorpusSpec("tiny", "tiny", "train", "en", "text", "label", dataset_id="local/tiny")
    row = profile.summary_rows(summary, registry_frame(spark, (spec,))).first()
    assert row.is_binary and row.role == "train" and row.dataset_id == "local/tiny"
    assert (row.char_len_p95, row.word_len_p95) == (9.0, 2.0)
    assert row.label_counts == "{'0': 1, '1': 1}"
    assert profile.quality_flags(summary, "corpus").count() == 0


def test_every_flag(spark):
    rows = [("x" * 300, "neg"), ("x" * 300, "neg"), (" ", "neg"), ("y", "pos")]
    eda = profile.stack_corpora(
        {"bad": profile.eda_frame(labelled(spark, rows, "string"), "text", "label", "en")}
    )
    summary = profile.summarize_corpora(eda, ["corpus", "language"])
    found = {r.rule for r in profile.quality_flags(summary, "corpus").collect()}
    assert found == {
        "label_skew", "duplicates", "empty_texts", "long_texts", "labels_need_mapping",
    }
    single = summary.withColumn("is_binary", F.lit(False))
    assert "not_binary" in {r.rule for r in profile.quality_flags(single, "corpus").collect()}


@pytest.mark.parametrize(
    ("kind", "values", "expected"),
    [
        ("int", [0, 1, 1], 0.6667),
        ("int", [1, 1], 1.0),
        ("int", [0, 4, 4, 4], 0.75),
        ("int", [0, 1, 2], None),
        ("int", [0, None], None),
        ("double", [0.0, 1.0], 0.5),
        ("boolean", [True, False, False], 0.3333),
        ("string", ["0", "1"], 0.5),
        ("string", ["Negative", "positive", "POSITIVE"], 0.6667),
        ("string", ["neg", "POS"], 0.5),
        ("string", ["pos", "positive"], None),
        ("string", ["pos", None], None),
        ("string", [], None),
    ],
)
def test_positive_ratio(spark, kind, values, expected):
    df = spark.createDataFrame([(v,) for v in values], f"label {kind}")
    assert profile.positive_ratio(df, "label").first().positive_ratio == expected


def test_corpus_profile(spark):
    row = profile.corpus_profile(labelled(spark, [("good", 1), ("bad", 0), ("", 1)]), "text", "label").first()
    assert row.n_rows == 3
    assert row.label_counts == {"0": 1, "1": 2}
    assert (row.empty_texts, row.char_len_min, row.char_len_max) == (1, 0, 4)
    assert (row.char_len_mean, row.word_len_mean) == (2.3, 0.7)
    assert row.columns == "text, label"
    nulls = profile.corpus_profile(labelled(spark, [(None, 1)]), "text", "label").first()
    assert (nulls.char_len_max, nulls.empty_texts) == (0, 1)
    nothing = profile.corpus_profile(labelled(spark, []), "text", "label").first()
    assert (nothing.n_rows, nothing.char_len_mean, nothing.label_counts) == (0, 0.0, {})


def test_profiles_frame(spark):
    one = profile.corpus_profile(labelled(spark, [("a", 1)]), "text", "label")
    assert [r.name for r in profile.profiles_frame({"x": one, "y": one}).collect()] == ["x", "y"]


def test_floor_quantiles(spark):
    df = spark.range(1, 11).select(F.col("id").alias("v"))
    row = histogram.quantiles(df, [], "v", {"a": 0.5, "b": 0.9, "c": 0.95}).first()
    assert tuple(row) == (5.0, 9.0, 9.0)


def test_histogram_of_equal_lengths_and_closed_last_bin(spark):
    flat = spark.createDataFrame([(5,), (5,)], "v int")
    assert [tuple(r) for r in histogram.length_histogram(flat, [], "v").collect()] == [
        (15, 5.0, 4.5 + 16 / 30, 2)
    ]
    wide = spark.range(0, 61).select(F.col("id").alias("v"))
    bins = {r.bin: r["count"] for r in histogram.length_histogram(wide, [], "v").collect()}
    assert bins == {**dict.fromkeys(range(29), 2), 29: 3}


def test_boxplot(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 100)], "v int")
    row = histogram.boxplot_stats(df, [], "v").first()
    assert tuple(row) == (2.0, 3.0, 4.0, 1, 4, 1)


def test_token_length_stats(spark):
    df = spark.createDataFrame(
        [(i, "w " * i) for i in range(1, 11)] + [(11, "w " * 300)], "id long, text string"
    )
    head = profile.token_length_stats(df, "text", "id", max_samples=10).first()
    assert tuple(head) == (10, 5.5, 5.0, 9.0, 10, 0.0)
    whole = profile.token_length_stats(df, "text", "id", max_samples=None).first()
    assert whole.token_sample_size == 11
    assert whole.pct_over_max_tokens == 9.09
    assert not math.isnan(whole.token_len_mean)
