"""Subwords against the public library, words of unspaced texts and quantiles against brute force."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentiweave.functions.text import token_count, truncate_tokens
from sentiweave.operators import pairtable, quantiles, segmentation, subwords
from sentiweave.operators.histogram import boxplot_stats
from sentiweave.plans.studies import token_fragmentation

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=subwords.default_vocabulary())


@pytest.fixture(scope="module")
def pieces():
    return subwords.Pieces.read(subwords.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=60))
def test_any_text_is_encoded_as_by_the_library(library, pieces, text):
    assert pieces.encode(text) == library.encode(text)


def test_whole_documents_are_encoded_as_by_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = ["", None, "  ", "a  b\n\tc", "▁ ▁▁x", "x" * 30_000, "中文没有空格 混合 text 🎉", "<s> </s> <0x41>"]
    docs = docs.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], docs.schema))
    encoder = subwords.Subwords(spark)
    columns = [encoder.ids(F.col("text")).alias("ids"), token_count(F.col("text"), encoder.tokenizer()).alias("n")]
    rows = docs.select("text", *columns).withColumn("back", encoder.text_of(F.col("ids"))).collect()
    for row in rows:
        assert row.ids == library.encode(row.text or "") and row.n == len(row.ids) + 2
        assert row.back == (row.text or "").replace("▁", " ")


def test_truncation_and_inputs(spark, library):
    encoder = subwords.Subwords(spark)
    text = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    cut = truncate_tokens(F.col("text"), 5, encoder.tokenizer())
    assert [r[0] for r in df.select(cut).collect()] == [library.decode(library.encode(text)[:5]), ""]
    ids = subwords.subword_inputs(df, "text", encoder, 7).collect()
    assert ids[0].input_ids == [1, *library.encode(text)[:5], 2] and ids[0].attention_mask == [1] * 7
    assert ids[1].input_ids == [1, 2]
    found = token_fragmentation(df.withColumn("lang", F.lit("en")), "text", ["lang"], encoder.tokenizer()).collect()
    assert found[0].subwords_per_word >= 1


def cheapest(graph, text):
    """The cost of the best of all ways to cut a short text."""
    best = math.inf
    for marks in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(text)]
        cost = 0.0
        for a, b in zip(cuts, cuts[1:]):
            cost += graph.costs.get(text[a:b], graph.unknown if b - a == 1 else math.inf)
        best = min(best, cost)
    return best


def test_word_graph_finds_the_cheapest_path():
    rng = random.Random(3)
    for _ in range(60):
        known = {"".join(rng.choices("abc", k=rng.randrange(1, 4))): rng.uniform(0.1, 5) for _ in range(8)}
        graph = segmentation.WordGraph(known, 6.0, 3)
        text = "".join(rng.choices("abcd", k=rng.randrange(1, 11)))
        ends = graph.cut(text)
        words = [text[a:b] for a, b in zip([0, *ends], ends)]
        assert "".join(words) == text
        assert sum(known.get(w, 6.0) for w in words) == pytest.approx(cheapest(graph, text))
    assert segmentation.WordGraph({}, 1.0, 1).cut("") == []


def test_words_of_a_script_without_spaces(spark):
    counts = spark.createDataFrame([("手机", 50), ("价格", 40), ("这个", 60), ("太高", 9), ("了", 90), ("的", 99), ("高", 5)], "word string, n long")
    graph = segmentation.WordGraph.fit(counts)
    df = spark.createDataFrame([("这个手机的价格太高了",), (None,), ("",)], "text string")
    cut = segmentation.segmenter(graph, df)
    assert [r[0] for r in df.select(cut("text")).collect()] == [["这个", "手机", "的", "价格", "太高", "了"], [], []]


def test_tokenization_gaps(spark, pieces):
    spaced = ["the cat sat on the mat", "the dog ate the cat", "", "émigré naïve cat"]
    df = spark.createDataFrame([(t, "x") for t in [*spaced * 3, None]], "text string, lang string")
    graph = segmentation.WordGraph.fit(segmentation.word_counts(df, "text"))
    text, lengths = segmentation.without_spaces(F.col("text")), segmentation.word_lengths(F.col("text"))
    rows = df.select("lang", text.alias("text"), lengths.alias("lengths"))
    (row,) = segmentation.tokenization_gaps(rows, "text", ["lang"], graph, subwords.Subwords(spark), F.col("lengths")).collect()
    assert row.texts == 13 and row.precision == row.recall == 1.0  # each word is in the dictionary, and none is made of others
    words = split = shared = n = 0
    for t in spaced * 3:
        plain, ends, at = t.replace(" ", ""), [], 0
        ids = pieces.encode(plain)
        n += len(ids)
        for end in range(1, len(ids) + 1):
            ends.append(len(pieces.decode(ids[:end]).replace("\ufffd", "")))
        for word in t.split():
            words += 1
            split += any(at < e < at + len(word) for e in ends)
            at += len(word)
            shared += at in ends
    assert (row.words, row.pieces) == (words, n)
    assert row.fragmentation_rate == pytest.approx(split / words) and row.shared_rate == pytest.approx(shared / words)


def brute(values, q, side):
    kept = sorted(v for v in values if v is not None and v == v)
    return kept[getattr(math, side)(q * (len(kept) - 1))] if kept else None


@pytest.mark.parametrize("accuracy", [5, 50, 10_000])
def test_exact_ranks(spark, accuracy):
    rng = random.Random(accuracy)
    kinds = {
        "normal": [rng.gauss(0, 1) for _ in range(4_000)],
        "one value": [2.5] * 700,
        "half": [1.0] * 600 + [rng.random() for _ in range(601)],
        "few": [3.0, None, float("nan"), -1.0],
        None: [float(i) for i in range(11)],
    }
    rows = [(g, v) for g, values in kinds.items() for v in values] + [("none", None), ("none", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ranks = {f"{side}{i}": (q, side) for i, q in enumerate([0.0, 0.013, 0.25, 0.5, 0.95, 1.0]) for side in ("floor", "ceil")}
    got = {r.g: r for r in quantiles.exact_ranks(df, ["g"], "v", ranks, accuracy).collect()}
    assert set(got) == set(kinds)
    for g, values in kinds.items():
        assert {n: got[g][n] for n in ranks} == {n: brute(values, q, side) for n, (q, side) in ranks.items()}
    whole = quantiles.exact_quantiles(df, [], "v", {"p50": 0.5}).collect()
    assert [r.p50 for r in whole] == [brute([v for _, v in rows], 0.5, "floor")]
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", {"p50": 0.5}).collect() == []


def test_exact_boxplot_equals_that_of_the_histogram(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(np.round(rng.standard_t(2, 3_000), 3))]
    df = spark.createDataFrame(rows, "g int, v double")
    columns = ["g", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    one, other = (sorted(tuple(r) for r in f(df, ["g"], "v").select(columns).collect()) for f in (quantiles.exact_boxplot, boxplot_stats))
    assert one == [pytest.approx(x) for x in other]


def test_chunks_are_cut_where_no_piece_goes_on(pieces, library, monkeypatch):
    fresh = subwords.Pieces(pieces.table, pieces.byte_ids, pieces.names, pieces.begin, pieces.end)
    plain = "the_quick#brown~fox" * 40  # one chunk, far longer than what is remembered
    assert fresh.encode(plain) == library.encode(plain)
    assert 0 < len(fresh.seen_parts) < 12 and set(fresh.seen) <= {""}
    assert fresh._joined_long("▁there") == fresh._joined("▁there")
    monkeypatch.setattr(subwords, "REMEMBERED", 5)
    words = [f"w{i % 9}" for i in range(60)]
    assert fresh.encode(" ".join(words)) == library.encode(" ".join(words))
    assert len(fresh.seen) <= 5 and len(fresh.seen.older) == 5


def test_truncation_encodes_no_more_than_it_keeps(spark, pieces, library):
    fresh = subwords.Pieces(pieces.table, pieces.byte_ids, pieces.names, pieces.begin, pieces.end)
    text = " ".join(f"word{i}" for i in range(5_000))
    assert fresh.first(text, 10) == library.encode(text)[:10] and len(fresh.seen) <= 10
    assert fresh.first(text, 0) == fresh.first("", 5) == [] and fresh.first("a b", 9) == library.encode("a b")
    encoder = subwords.Subwords(spark)
    df = spark.createDataFrame([(text,), ("",), (None,), ("  é 中",)], "text string")
    found = [r[0] for r in df.select(truncate_tokens(F.col("text"), 7, encoder.tokenizer())).collect()]
    assert found == [library.decode(library.encode(t or "")[:7]) for t in (text, "", None, "  é 中")]


def test_long_words_go_on_from_their_beginnings():
    known = {"a": 1.0, "ab": 1.5, "abcd": 2.0, "abcde": 2.5, "abcdefgh": 9.0, "cd": 0.5, "": 0.1, "fgh": 3.0}
    graph = segmentation.WordGraph(known, 6.0, 7)
    assert graph.cut("abcdefghx") == [5, 8, 9]  # eight characters are more than the longest
    assert segmentation.WordGraph(known, 6.0, 8).cut("abcdefghab") == [5, 8, 10]
    # Of equal costs the last word is the longest: ab + cd and abcd.
    assert graph.cut("abcd") == [4] and set(graph._begun) >= {"abcd", "bcd", "cd", "d"}
    assert segmentation.piece_ends(["ab", "c"], [0, 1, 0], range(5, 6)).tolist() == [2, 3, 5]


def joined(rng, strings, n):
    return "".join(rng.choices(strings, k=n))


@pytest.mark.parametrize("stretch", [2_000, 5])
def test_texts_cut_side_by_side_are_cut_as_one_by_one(monkeypatch, stretch):
    monkeypatch.setattr(segmentation, "_STRETCH", stretch)  # longer stretches are cut alone
    rng = random.Random(5)
    for case in range(150):
        words = [joined(rng, "abc中🎉 ", rng.randrange(1, 7)) for _ in range(rng.randrange(0, 25))]
        # Few different costs make equal paths, which the rounding of sums chooses between.
        known = {w: rng.choice([0.1, 0.2, 0.3, 0.7, 1.1]) if case % 2 else rng.uniform(0.1, 9) for w in words}
        graph = segmentation.WordGraph(known, 6.0, rng.randrange(1, 8))
        texts = [joined(rng, [*words, "a", "b", "x", "\0"], rng.randrange(0, 60)) for _ in range(rng.randrange(1, 12))]
        codes, places, sizes = pairtable.code_points(texts)
        last = graph.last_characters(codes, places)
        for text, at, size in zip(texts, places, sizes):
            assert (np.flatnonzero(last[at + 1 : at + 1 + size]) + 1).tolist() == graph.cut(text)


def test_few_stretches_of_texts_are_cut_alone(monkeypatch):
    rng = random.Random(6)
    words = [joined(rng, "etaoinshrdlu", rng.randrange(1, 8)) for _ in range(3_000)]
    graph = segmentation.WordGraph({w: rng.uniform(3, 9) for w in words}, 12.0, 24)
    texts, alone = [joined(rng, [*words, "."], 400) for _ in range(20)], []
    one_by_one = [graph.cut(t) for t in texts]
    cheapest = segmentation.WordGraph._cheapest
    monkeypatch.setattr(segmentation.WordGraph, "_cheapest", lambda self, t, b: alone.append(len(t)) or cheapest(self, t, b))
    codes, places, _ = pairtable.code_points(texts)
    last = graph.last_characters(codes, places)
    assert np.flatnonzero(np.delete(last, places)).size == sum(map(len, one_by_one))
    assert sum(alone) < 0.05 * len(codes)


@pytest.mark.parametrize("widths", [subwords._WIDTHS, (2, 4)])
def test_pieces_start_where_the_library_starts_them(pieces, library, monkeypatch, widths):
    monkeypatch.setattr(subwords, "_WIDTHS", widths)  # longer parts are joined alone
    rng = random.Random(7)
    names = [n.replace(subwords.SPACE, rng.choice([" ", subwords.SPACE])) for n in pieces.table]
    texts = [joined(rng, [*names, "x", "🎉", "ሴ", "<0x41>", "==", "  "], rng.randrange(0, 40)) for _ in range(400)]
    texts += ["", " ", "a", "=" * 700, "the" * 300, "abcdefghijklmnopqrstuvwxyz" * 30, "中文没有空格" * 50]
    codes, places, sizes = pairtable.code_points(texts)
    started, ids = pieces.starts(codes, places)
    byte_ids = range(pieces.byte_ids[0], pieces.byte_ids[0] + 256)
    for text, at, size in zip(texts, places, sizes):
        expected = library.encode(text)
        ends = np.unique(segmentation.piece_ends(pieces.names, expected, byte_ids)).tolist()
        if text:
            assert [*np.flatnonzero(started[at + 1 : at + 1 + size]) + 1, size + 1] == [e for e in ends if e]
            assert ids[at : at + 1 + size].sum() == len(expected)


def test_joins_that_undercut_their_parts_are_made_in_order():
    # A joint may have a better score than its parts, and characters may have no piece of their own.
    rng = random.Random(8)
    for _ in range(40):
        names = {joined(rng, "abc", rng.randrange(1, 6)) for _ in range(14)} | {subwords.SPACE}
        table = {n: (i + 256, rng.choice([-1.0, -2.0, -3.0, float(-i)])) for i, n in enumerate(sorted(names))}
        made = subwords.Pieces(table, list(range(256)), [*map(str, range(256)), *sorted(names)], -1, -1)
        texts = [joined(rng, "abcd", rng.randrange(0, 50)) for _ in range(10)]
        codes, places, sizes = pairtable.code_points(texts)
        started, ids = made.starts(codes, places)
        for text, at, size in zip(texts, places, sizes):
            lengths = np.cumsum([len(p) for p in made._joined_long(subwords.SPACE + text)])
            assert [*np.flatnonzero(started[at + 1 : at + 1 + size]) + 1, size + 1] == lengths.tolist()
            assert not text or ids[at : at + 1 + size].sum() == len(made.encode(text))


def test_gaps_of_each_text_among_others(pieces):
    rng = random.Random(9)
    words = [joined(rng, "abcdeé中", rng.randrange(1, 6)) for _ in range(60)]
    graph = segmentation.WordGraph({w: rng.uniform(1, 9) for w in words}, 12.0, 24)
    texts, lengths = [], []
    for _ in range(50):
        cut = rng.choices(words, k=rng.randrange(0, 30))
        texts.append("".join(cut))
        lengths.append(rng.choice([[len(w) for w in cut], None, [0, 2, 0, 900]]))
    byte_ids = range(pieces.byte_ids[0], pieces.byte_ids[0] + 256)
    found = segmentation._gaps(graph, pieces, texts, pa.array(lengths, pa.list_(pa.int32())))
    for text, true, row in zip(texts, lengths, found.T.tolist()):
        ends, ids = graph.cut(text), pieces.encode(text)
        cuts = {e - 1 for e in segmentation.piece_ends(pieces.names, ids, byte_ids).tolist() if e > 1}
        split = sum(any(a < c < b for c in cuts) for a, b in zip([0, *ends], ends))
        known = set(itertools.accumulate(true or []))
        assert row == [1, len(ends), len(ids), split, len(cuts & set(ends)), len(true or []), len(known & set(ends))]


def test_gaps_of_many_texts_and_of_one_are_alike(spark, monkeypatch):
    texts = [("a b" * (i % 50), "x" if i % 3 else None) for i in range(500)] + [(None, "x"), ("", None)]
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    graph, encoder = segmentation.WordGraph.fit(segmentation.word_counts(df, "text")), subwords.Subwords(spark)
    rows = df.select("lang", segmentation.without_spaces(F.col("text")).alias("t"), segmentation.word_lengths(F.col("text")).alias("n"))
    together = sorted(segmentation.tokenization_gaps(rows, "t", ["lang"], graph, encoder, F.col("n")).collect(), key=str)
    assert sum(r.texts for r in together) == 502 and len(together) == 2
    assert "recall" not in segmentation.tokenization_gaps(rows, "t", ["lang"], graph, encoder).columns
    batch = pa.array([t for t, _ in texts])
    for n in (1, 2, 1_000):
        monkeypatch.setattr(segmentation, "_TOGETHER", n)
        assert [t for part, _ in segmentation._together(batch, batch) for t in part] == [t or "" for t, _ in texts]


def test_tasks_give_no_word_rarer_than_the_last_one(spark):
    rows = [(f"w{i:04}", 1 + i % 7) for i in range(2_000)] + [("", 99), ("none", 0)]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(8)
    kept_before = set(spark.sparkContext._jsc.getPersistentRDDs())
    for size in (1, 300, 5_000):
        graph = segmentation.WordGraph.fit(counts, size)
        kept = sorted(((n, w) for w, n in rows if n and w), key=lambda x: (-x[0], x[1]))[:size]
        assert list(graph.costs) == [w for _, w in kept]
        total = sum(n for n, _ in kept)
        assert graph.costs == {w: -math.log(n / total) for n, w in kept}
    assert segmentation.WordGraph.fit(counts.where("false")).costs == {}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept_before
