import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sentiweave.functions.numeric import prediction_columns, with_softmax
from sentiweave.operators import metrics, ranktest
from sentiweave.operators.ranktest import mann_whitney, mann_whitney_pairs, mann_whitney_samples
from sentiweave.operators.ratios import sentiment_ratios


def sample(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


@pytest.mark.parametrize("slices", [2, 64])
def test_u_equals_pair_count(spark, monkeypatch, slices):
    monkeypatch.setattr(ranktest, "_SLICES", slices)
    rng = random.Random(slices)
    a = [rng.randrange(20) for _ in range(150)] + [3] * 100
    b = [rng.gauss(10, 6) for _ in range(120)] + [3] * 50
    row = mann_whitney_samples(sample(spark, a), sample(spark, b), "v").first()
    assert row.u == brute_u(a, b)
    assert (row.n_a, row.n_b) == (250, 170)
    n = 420
    tied = sum(t**3 - t for t in (len(list(g)) for _, g in itertools.groupby(sorted(a + b))))
    sigma = math.sqrt(250 * 170 / 12 * ((n + 1) - tied / (n * (n - 1))))
    z = (max(row.u, 250 * 170 - row.u) - 250 * 170 / 2 - 0.5) / sigma
    assert row.z == pytest.approx(z, rel=1e-12)
    assert row.p_value == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-12)


def brute_exact_p(a, b):
    """Two-sided p over all ways to pick sample A's ranks."""
    pooled, n = sorted(a + b), len(a)
    us = [
        sum(picked) - n * (n - 1) // 2
        for picked in itertools.combinations(range(len(pooled)), n)
    ]
    u = brute_u(a, b)
    top = max(u, len(a) * len(b) - u)
    return min(1.0, 2 * sum(x >= top for x in us) / len(us))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ([1, 2, 3], [4, 5, 6, 7]),
        ([1, 5, 9], [2, 3, 8, 11, 12]),
        ([10, 20], [15]),
        ([1, 4, 6, 9], [2, 3, 5, 7, 8, 10, 11, 12, 13]),
    ],
)
def test_small_samples_are_exact(spark, a, b):
    row = mann_whitney_samples(sample(spark, a), sample(spark, b), "v").first()
    assert row.p_value == pytest.approx(brute_exact_p(a, b), rel=1e-12)


def test_small_samples_with_ties_use_the_normal_law(spark):
    row = mann_whitney_samples(sample(spark, [1, 2, 2]), sample(spark, [2, 3, 4]), "v").first()
    assert row.ties == 24
    assert row.p_value == pytest.approx(math.erfc(row.z / math.sqrt(2)))


def test_degenerate_samples(spark):
    equal = mann_whitney_samples(sample(spark, [5, 5]), sample(spark, [5]), "v").first()
    assert (equal.u, equal.z, equal.p_value) == (1.0, None, 1.0)
    alone = mann_whitney_samples(sample(spark, [5]), sample(spark, []), "v").first()
    assert (alone.u, alone.p_value) == (None, None)
    broken = mann_whitney_samples(sample(spark, [float("nan"), 1]), sample(spark, [2]), "v").first()
    assert (broken.u, broken.p_value) == (None, None)


def test_pairs_agree_with_single_tests(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), rng.choice("ab"), rng.randrange(30)) for _ in range(600)]
    df = spark.createDataFrame(rows, "lang string, topic string, v int")
    found = mann_whitney_pairs(df, "v", "lang", ["z", "x", "y"], ["topic"]).collect()
    assert len(found) == 6
    for r in found:
        a = [v for lang, topic, v in rows if (lang, topic) == (r.sample_a, r.topic)]
        b = [v for lang, topic, v in rows if (lang, topic) == (r.sample_b, r.topic)]
        assert r.u == brute_u(a, b)
    single = mann_whitney(df.where("lang <> 'z'"), "v", F.col("lang") == "x", ["topic"])
    pair = {(r.topic, r.u) for r in found if (r.sample_a, r.sample_b) == ("x", "y")}
    assert {(r.topic, r.u) for r in single.collect()} == pair


def test_sentiment_ratios(spark):
    df = spark.createDataFrame(
        [("en", 1), ("en", 0), ("en", None), (None, 1)], "lang string, sentiment_label int"
    )
    assert [tuple(r) for r in sentiment_ratios(df, ["lang"]).collect()] == [
        (None, 1.0, 1),
        ("en", 0.5, 3),
    ]
    with pytest.raises(ValueError, match="Missing columns"):
        sentiment_ratios(df, ["topic"])


def test_metrics_on_separable_logits(spark):
    df = spark.createDataFrame(
        [([2.0, 0.5], 0), ([0.1, 3.0], 1), ([1.0, 0.2], 0)], "logits array<double>, label int"
    ).withColumn("guess", metrics.predicted_class(F.col("logits")))
    row = metrics.binary_metrics(df, "label", "guess").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 1.0, 1.0, 1.0)


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, guess int")
    row = metrics.binary_metrics(df, "label", "guess").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_metrics_long(spark):
    df = spark.createDataFrame([("zh", 1, 1), ("en", 1, 0)], "language string, label int, guess int")
    per = metrics.binary_metrics(df, "label", "guess", ["language"])
    found = {r.metric: r.value for r in metrics.metrics_long(per).collect()}
    assert len(found) == 8
    assert found["val_zh_eval_f1"] == 1.0 and found["val_en_eval_accuracy"] == 0.0


def test_range_violations(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 1.5), (2, -0.1, 0.5), (None, None, None)],
        "sentiment_label int, sentiment_score double, confidence double",
    )
    found = {r.rule: r.violations for r in metrics.range_violations(df).collect()}
    assert found == {"sentiment_label": 2, "sentiment_score": 2, "confidence": 2}


def test_audit(spark):
    df = spark.createDataFrame([("a",)], "text string")
    rows = metrics.audit_sources({"x": (df, ["text"]), "y": (df.limit(0), ["text", "label"])})
    assert [tuple(r) for r in rows.collect()] == [
        ("x", 1, "", True),
        ("y", 0, "missing column label", False),
    ]


def test_softmax_and_ties(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, math.log(3)],)], "z array<double>")
    scored = with_softmax(df, "z").withColumns(prediction_columns(F.col("probabilities")))
    first, second = scored.collect()
    assert (first.sentiment_label, first.sentiment_score, first.confidence) == (0, 0.5, 0.5)
    assert second.sentiment_label == 1
    assert second.sentiment_score == pytest.approx(0.75)
