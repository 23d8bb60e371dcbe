"""Inference in length buckets, selection on F1, summaries of growing corpora."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiweave.operators import profile
from sentiweave.plans import bayes, embedding, inference, scoring, selection
from sentiweave.plans.summaries import GrowingSummary
from sentiweave.sources.snapshots import SnapshotTable


def test_batches_keep_to_their_budget():
    rng = np.random.default_rng(2)
    for budget in (1, 50, 1_000):
        sizes = np.sort(rng.integers(0, 60, 300))
        ends = inference.batch_ends(sizes, budget)
        starts = [0, *ends[:-1]]
        assert ends[-1] == 300
        for a, b in zip(starts, ends):
            assert b - a == 1 or sizes[a:b].max() * (b - a) <= budget
    assert inference.batch_ends(np.array([], np.int64), 5) == []


def test_padding():
    ids, mask = inference.padded(np.array([7, 8, 9]), np.array([1, 0, 2]))
    assert ids.tolist() == [[7, 0], [0, 0], [8, 9]]
    assert mask.tolist() == [[True, False], [False, False], [True, True]]


def weigher():
    def model(ids, mask):
        assert ids.shape == mask.shape and ids.size <= 40 or len(ids) == 1
        return np.stack([(ids * mask).sum(axis=1), mask.sum(axis=1)], axis=1)

    return model


def test_scores_equal_those_of_single_rows(spark):
    rng = random.Random(5)
    rows = [(i, "keep", [rng.randrange(100) for _ in range(rng.randrange(30))]) for i in range(400)]
    rows += [(1_000, "null", None), (1_001, "empty", []), (1_002, "long", list(range(500)))]
    df = spark.createDataFrame(rows, "k long, other string, ids array<int>").repartition(5)
    out = inference.score_by_length(df, "ids", weigher, "made", 40)
    assert out.columns == ["k", "other", "ids", "made"]
    got = {r.k: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, other, ids in rows:
        assert got[k].made == [float(sum(ids or [])), float(len(ids or []))]
        assert (got[k].other, got[k].ids) == (other, ids)
    assert inference.score_by_length(df.limit(0), "ids", weigher).collect() == []
    with pytest.raises(ValueError, match="already"):
        inference.score_by_length(df, "ids", weigher, "other")


def test_a_worker_loads_its_model_once(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda ids, mask: np.zeros((len(ids), 2))

    df = spark.range(400).select(F.array(F.col("id").cast("int")).alias("ids")).repartition(40)
    inference.score_by_length(df, "ids", load).write.format("noop").mode("overwrite").save()
    assert 0 < loads.value < 40


def test_selection_on_f1(spark):
    rng = random.Random(1)
    rows = [(y, rng.gauss(y, 0.6)) for y in (0, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    steps = [i / 10 for i in range(-10, 20)]
    measured = selection.f1_by_threshold(df, "y", "s", steps)

    def f1(t):
        tp, fp, fn = (sum(1 for y, s in rows if (y, s >= t) == k) for k in ((1, True), (0, True), (1, False)))
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    got = {r.threshold: r.f1 for r in measured.collect()}
    assert got == {t: pytest.approx(f1(t)) for t in steps}
    assert selection.select_threshold(measured) == max(steps, key=lambda t: (got[t], -t))
    with pytest.raises(ValueError, match="no rows"):
        selection.select_threshold(selection.f1_by_threshold(df.limit(0), "y", "s", steps))


def test_parts_add_up_to_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("a bb ccc".split(), k=rng.randrange(4))), rng.choice([0, 1, None]), rng.choice(["en", "zh"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, label int, language string")
    eda = profile.eda_frame(df, "text", "label", F.col("language"))
    whole = sorted(map(str, profile.summarize_corpora(eda).collect()))
    halves = [F.col("char_len") < 4, F.col("char_len") >= 4]
    growing = GrowingSummary(spark, str(tmp_path / "s"))
    for name, half in zip("ab", halves):
        growing.add(name, eda.where(half))
    assert sorted(map(str, growing.summary().collect())) == whole
    growing.add("b", eda.limit(0))  # counted anew: the other part isn't read
    growing.add("b", eda.where(halves[1]))
    assert growing.parts() == ["a", "b"] and sorted(map(str, growing.summary().collect())) == whole
    growing.compact()
    assert growing.parts() == ["all"] and sorted(map(str, growing.summary().collect())) == whole
    SnapshotTable(spark, str(tmp_path / "s")).expire(1)
    assert sorted(map(str, growing.summary().collect())) == whole


def sentences(seed, n):
    rng = random.Random(seed)
    good, bad, rest = "lovely great fine".split(), "awful bad poor".split(), "the a film was it and so".split()
    rows = []
    for i in range(n):
        y = rng.randrange(2)
        text = rng.choices(rest, k=rng.randrange(3, 9)) + rng.choices(good if y else bad, k=2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), y))
    return rows


OPTIONS = embedding.EmbeddingOptions(buckets=256, size=8, epochs=4, batches=4)


def test_gradients_are_those_of_the_loss():
    layers = embedding.first_layers(embedding.EmbeddingOptions(buckets=5, size=3))
    ids, sizes, labels = np.array([0, 1, 1, 4]), np.array([3, 0, 1]), np.array([1.0, 0.0, 1.0])
    found = embedding.gradients(layers, ids, sizes, labels)
    for name in layers:
        for at in np.ndindex(layers[name].shape):
            sides = []
            for step in (1e-6, -1e-6):
                moved = {n: v.copy() for n, v in layers.items()}
                moved[name][at] += step
                sides.append(embedding.gradients(moved, ids, sizes, labels)["_sums"][0])
            assert found[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def test_rates_warm_up_and_fall():
    rates = [embedding.rate_at(i, 50, embedding.EmbeddingOptions(rate=1.0, warmup=0.2)) for i in range(50)]
    assert rates[0] == 0.1 and max(rates) == 1.0 and rates.index(1.0) == 9
    assert rates[:10] == sorted(rates[:10]) and rates[10:] == sorted(rates[10:], reverse=True) and 0 < rates[-1] < 0.05


def test_embedding_classifier_learns_and_repeats(spark):
    train = spark.createDataFrame([*sentences(1, 600), (9_000, None, 1), (9_001, "no label", None)], "id long, text string, label int")
    model = embedding.fit_embedding(train.repartition(3), "id", OPTIONS)
    again = embedding.fit_embedding(train.repartition(7), "id", OPTIONS)
    assert all(np.array_equal(model.layers[n], again.layers[n]) for n in model.layers)
    other = embedding.fit_embedding(train, "id", embedding.EmbeddingOptions(**{**OPTIONS.__dict__, "seed": 1}))
    assert not np.array_equal(model.layers["output"], other.layers["output"])
    assert np.mean(model.losses[-4:]) < 0.5 * np.mean(model.losses[:2])
    held = spark.createDataFrame([*sentences(2, 200), (9_000, None, 0)], "id long, text string, label int")
    rows = held.withColumns({"lang": F.lit("en"), "topic": F.lit("t")})
    found = scoring.predict_corpus(rows, embedding.embedding_scorer(model, rows)).collect()
    assert len(found) == 201
    assert np.mean([r.sentiment_label == r.label for r in found]) > 0.95


def test_frozen_layers_stay(spark):
    train = spark.createDataFrame(sentences(3, 120), "id long, text string, label int")
    options = embedding.EmbeddingOptions(**{**OPTIONS.__dict__, "frozen": ("embedding",), "epochs": 1})
    model, first = embedding.fit_embedding(train, "id", options), embedding.first_layers(options)
    assert np.array_equal(model.layers["embedding"], first["embedding"])
    assert not np.array_equal(model.layers["output"], first["output"])
    with pytest.raises(ValueError, match="no layers"):
        embedding.fit_embedding(train, "id", embedding.EmbeddingOptions(frozen=("head",)))


def test_steps_look_up_one_number_a_word(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    layers = embedding.first_layers(embedding.EmbeddingOptions(buckets=50, size=7))
    layers["bias"][0] = 0.25
    ids, sizes, labels = rng.integers(0, 50, 400), np.array([0, 150, 0, 249, 1]), np.array([1.0, 0, 0, 1, 1])
    texts = np.split(ids, np.cumsum(sizes)[:-1])
    means = np.array([layers["embedding"][t].sum(axis=0) / max(1, len(t)) for t in texts])
    z = means @ layers["output"] + 0.25
    assert np.allclose(embedding.odds(embedding.word_odds(layers), 0.25, ids, sizes), z)
    off = 1 / (1 + np.exp(-z)) - labels
    assert np.allclose(embedding.gradients(layers, ids, sizes, labels)["output"], off @ means)
    # A batch is read by many tasks, whose rows are bytes.
    monkeypatch.setattr(embedding, "scratch_path", lambda spark, name: str(tmp_path / name))
    train = spark.createDataFrame([*sentences(5, 900), (None, "twice", 1), (None, "twice", 1)], "id long, text string, label int")
    embedding.fit_embedding(train, "id", embedding.EmbeddingOptions(buckets=64, size=4, epochs=1, batches=2))
    table = spark.read.parquet(str(tmp_path / "batches"))
    assert table.count() == 902 and dict(table.dtypes)["ids"] == "binary"
    for batch in (0, 1):
        assert len(list((tmp_path / "batches" / f"batch={batch}").glob("*.parquet"))) > 8


def test_frequent_words_are_summed_where_texts_lie(spark, monkeypatch):
    monkeypatch.setattr(bayes, "FREQUENT", 12)
    train = spark.createDataFrame([*sentences(7, 80), (900, None, 1), (901, "rare once", 0)], "id long, text string, label int")
    model = bayes.BayesModel.fit(train)
    n, often = model.words.count(), {r.word for r in model.frequent.collect()}
    assert 0 < len(often) <= 12 < n and "once" not in often
    rows = [*sentences(8, 40), (500, "", 0), (501, None, 0), (502, "once unseen unseen", 0), (503, "the the", 0), (None, "a b", 1), (503, "film", 1)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    found = sorted(map(str, model.score(df, "id").collect()))
    weights = {r.word: r.weight for r in model.words.collect()}
    sums = {}
    for i, text, _ in rows:
        if i is not None:
            sums[i] = sums.get(i, 0) + sum(weights.get(w, model.unseen) for w in (text or "").split())
    odds = {i: model.prior + s for i, s in sums.items()}
    whole = bayes.BayesModel(model.words, model.unseen, model.prior)
    assert found == sorted(map(str, whole.score(df, "id").collect())) and len(found) == len(rows)
    got = {r.id: r.log_odds for r in model.score(df, "id").collect()}
    assert got == odds | {None: model.prior}
