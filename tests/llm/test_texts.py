"""Operators on single texts against brute force: BPE, fingerprints, suffixes, winnowing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentiweave.llm import bpe, decontaminate, lines, simhash, suffixes, toxicity

ODD = [
    None, "", " ", "\n\n  \t", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's I'LL we've'd",
    "ａ　  ½Ⅷ²", "日本語のテキスト🎉🎉", "aaaa" * 200, "abababab" * 30, "\x1c\x85\xa0 q", "naïve Œuvre",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


def random_texts(count, seed=1):
    rng = random.Random(seed)
    wide = [*range(32, 127), *range(0xA0, 0x250), 0x4E00, 0x1F600, 10, 9, 32, 32, 32]
    return ["".join(chr(rng.choice(wide)) for _ in range(rng.randrange(200))) for _ in range(count)]


def test_bpe_equals_library(spark, library):
    texts = ODD + random_texts(60)
    coded = bpe.encode(frame(spark, texts), "text", bpe.vocabulary())
    both = bpe.decode(coded, "token_ids", bpe.vocabulary()).orderBy("doc_id").collect()
    assert len(both) == len(texts)
    for row, text in zip(both, texts, strict=True):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(row["token_ids"]), "<u4").tolist() == expected
        assert row["decoded"] == library.decode(expected, skip_special_tokens=False) == (text or "")
        assert row["source"] is not None


def test_bpe_digests_of_tables(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in bpe.round_trip_digests(docs, bpe.vocabulary()).collect():
        ids = np.array(library.encode(texts[row["doc_id"]], add_special_tokens=False).ids, "<u4")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_bpe_word_split_of_all_characters(library):
    own = bpe.ByteBpe(bpe.vocabulary())
    split = own.ready()[0]
    for base in range(0, 0x30000, 7):
        if 0xD800 <= base < 0xE000:
            continue
        text = f"a{chr(base)}1{chr(base)}!{chr(base)} x"
        spans, at = [], 0
        for word in split[bpe._width(text)](text):
            spans.append((at, at + len(word)))
            at += len(word)
        assert spans == [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)], hex(base)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(items, near):
    """item -> smallest item that is reachable."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if near(a, b):
                one, other = find(a), find(b)
                root[max(one, other)] = min(one, other)
    return {x: find(x) for x in items}


def test_simhash_groups(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(12)]
    texts = list(ODD)
    for text in base:
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r for r in simhash.near_groups(frame(spark, texts)).collect()}
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    expected = closure(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r["fingerprint"] & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert len(set(expected.values())) < len(texts) - 10


def test_simhash_tree_finds_every_pair():
    """Chains of near fingerprints over many small shards: each near pair shares a shard."""
    rng = np.random.default_rng(8)
    points = [rng.integers(0, 2**64, 400, dtype=np.uint64)]
    for _ in range(6):
        points.append(points[-1] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    points = np.unique(np.concatenate(points))
    tree = simhash.VantageTree(points, leaf=100)
    assert tree.leaves > 10
    row, leaf = tree.shards(points)
    shards = defaultdict(set)
    for r, x in zip(row.tolist(), leaf.tolist(), strict=True):
        shards[r].add(x)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2).tolist():
            assert shards[i] & shards[j]


def test_simhash_keeps_one_of_each_group(spark):
    docs = frame(spark, ["a b c d e f"] * 5 + ["other words stand here"] + ["", None])
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 5, 6]


def test_simhash_keeps_one_row_of_repeated_ids(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 1), (1, "a b c d", 2), (None, "a b c d", 3), (None, "x y z w", 4)]
    rows += [(None, "x y z w", 4), (2, "p q r s", 5), (2, "p q r s t u v", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int").withColumns(
        {"a.b": F.col("other"), "`": F.lit(1), "h1": F.lit("x"), "row": F.lit(None).cast("map<int,int>")}
    )
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, "a b c d"), (2, "p q r s"), (2, "p q r s t u v"), (None, "x y z w")], key=str)
    assert sorted(map(str, kept.collect())) == sorted(map(str, simhash.one_of_each_group(docs.repartition(7)).collect()))


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(b for b, x in zip(r, gone, strict=True) if not x)))
    return out


@pytest.mark.parametrize("most_spans", [2_048, 1])
def test_suffixes(spark, most_spans):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, other = make(20), make(12)
    texts = list(ODD) + [make(30) for _ in range(10)]
    texts += [make(rng.randrange(12)) + passage[rng.randrange(20) :] + make(9) + other for _ in range(25)]
    texts += [texts[-1], texts[-1], texts[-2] + "!", "ab" * 300, "z" * 700, passage + passage]
    docs = frame(spark, texts)
    got = {
        r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"]))
        for r in suffixes.without_repeats(docs, 40, 13, most_spans).collect()
    }
    assert got == dict(enumerate(brute_repeats(texts, 40)))


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4_000).astype(np.uint8)
    at, limit = rng.integers(0, 3_900, 700), rng.integers(1, 60, 700)
    group = np.sort(rng.integers(0, 5, 700))
    order = suffixes.SuffixSort(data, suffixes.Powers()).order(at, limit, group)
    key = [(int(group[i]), data[at[i] : at[i] + limit[i]].tobytes()) for i in range(700)]
    assert [key[i] for i in order] == sorted(key)


def test_suffix_hash_collisions_are_seen(monkeypatch):
    """With hashes that are all alike the bytes decide."""
    rows = [(1, i, 0, 1, raw) for i, raw in enumerate([b"abcdefghij", b"klmnopqrst", b"abcdefghij"])]
    expected = [[{"first": 0, "end": 1}], [], [{"first": 0, "end": 1}]]
    assert suffixes.sort_spans(rows, 10, suffixes.Powers()) == expected
    monkeypatch.setattr(suffixes.SuffixSort, "hashes", lambda self, at, size: np.zeros(len(at), np.uint64))
    assert suffixes.sort_spans(rows, 10, suffixes.Powers()) == expected


def brute_hits(texts, items, window=10):
    own = [decontaminate.words_of(t or "") for t in texts]
    out = []
    for words in own:
        hit, ids = set(), set()
        for item, text in items:
            other = decontaminate.words_of(text or "")
            size = min(len(other), window)
            if not size:
                continue
            grams = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)}
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    if item is not None:
                        ids.add(str(item))
        out.append((len(words), len(hit), sorted(ids)))
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice("Aa b C d é1 2 x-y".split()) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(14)] + [(20, None), (None, make(12)), (7, make(12))]
    texts = list(ODD) + [make(40) for _ in range(10)]
    texts += [make(5) + " " + items[rng.randrange(14)][1].upper() + ", " + make(6) for _ in range(30)]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()}
    assert got == dict(enumerate(brute_hits(texts, items)))
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if not x[1]}


def test_winnowing_keeps_a_gram_of_every_shared_window():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**64, 10, dtype=np.uint64)
    for _ in range(200):
        own = [np.concatenate((rng.integers(0, 2**64, rng.integers(0, 20), dtype=np.uint64), shared, rng.integers(0, 2**64, rng.integers(0, 20), dtype=np.uint64))) for _ in range(2)]
        grams = [decontaminate.gram_hashes(x, 5) for x in own]
        kept = [set(g[decontaminate.winnow(g, 6)].tolist()) for g in grams]
        assert kept[0] & kept[1] & set(decontaminate.gram_hashes(shared, 5).tolist())


def test_lines(spark):
    texts = ["keep\nspread \n\nx", "y\r\n spread", "spread\nspread\nz", None, "", "near\nspread\nnear"] + ["near\nq"] * 3
    rows = [(i, t, f"s{i}" if i != 3 else None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    cut = lines.without_boilerplate(docs, min_sites=4, removed="gone")
    got = {r["doc_id"]: (r["text"], r["gone"], r["n_chars"]) for r in cut.collect()}
    assert got[0] == (texts[0], 0, 0)
    assert got[1] == ("y\r", 1, 2)
    assert got[2] == ("z", 2, 1)
    assert got[3] == (None, 0, 0)
    assert got[4] == ("", 0, 0)
    assert got[5][0] == "near\nnear" and got[6] == ("q", 1, 1)
    assert len(got) == len(texts)


CLASHING = "row doc cut cut_id removed site line _keeper _doc_id _key score features key gram at left spans runs kept".split()


def test_clashing_columns(spark):
    """Extra columns with any name that the operators use come through the filters."""
    texts = ["one two three four five six seven\nshared line", "shared line\nother words are here", None, ""]
    docs = frame(spark, texts).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})
    labels = spark.createDataFrame([], "doc_id long, toxic int, score string")
    items = spark.createDataFrame([(1, "nothing of it", "x")], "item_id long, text string, size string")
    for out in (
        toxicity.without_toxic(docs, labels),
        lines.without_boilerplate(docs, min_sites=2),
        simhash.one_of_each_group(docs),
        decontaminate.without_contaminated(docs, items),
    ):
        assert out.columns == docs.columns
        for row in out.collect():
            assert all(row[c] == f"{c}{row['doc_id']}" for c in CLASHING)
    assert suffixes.without_repeats(docs).count() == len(texts)
    assert bpe.encode(docs, "text", bpe.vocabulary(), "key").count() == len(texts)


def test_toxicity_features():
    weights = toxicity.Weights({"badword": 3.0, "awful-": 2.0})
    named = dict(zip(toxicity.FEATURES, toxicity.text_features("You badword! b.a.d.w.o.r.d AWFULLY", weights), strict=True))
    assert named["top_weight"] == 3.0 and named["near_second_person"] > 0 and named["obfuscated_hits"] > 0
    assert not any(toxicity.text_features("", weights))


def test_toxicity_of_few_labels(spark):
    """Parts have both classes whenever two documents of each are there; without a model nothing is dropped."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = frame(spark, ["bad vilexo word" if i % 2 else "a good word" for i in range(400)])
    few = [(i, int(k > 0)) for k, i in enumerate(ids[:8])]
    labels = spark.createDataFrame(few, "doc_id long, toxic int")
    model = toxicity.fit_without_held_out(docs, labels)
    assert model.trees is None
    assert toxicity.without_toxic(docs, labels).count() == 400
    even = spark.createDataFrame([(i, i % 2) for i in ids[:5]] + [(9_999, 1)], "doc_id long, toxic int")
    assert toxicity.fit_without_held_out(docs, even).trees is not None


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    clean = ["tree", "house", "river", "stone", "cloud", "garden", "window", "paper"]
    bad = ["vilexa", "vilexo", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(1_500):
        words = [rng.choice(clean) for _ in range(40)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, None, toxic))
    rows += [(None, None, None, None, None), (9_999, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    table = toxicity.toxicity_table(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(table) == len(rows) and all(0 <= r["score"] <= 1 for r in table)
    truth = {i: y for i, _, y in labels}
    held = [r for r in table if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 300
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    empty = toxicity.toxicity_table(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.collect() == []
    kept = toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and kept.count() < len(rows) - 200


def test_empty_tables(spark):
    docs = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_groups(docs).count() == 0
    assert simhash.one_of_each_group(docs).count() == 0
    assert suffixes.without_repeats(docs).count() == 0
    assert lines.without_boilerplate(docs).count() == 0
    assert decontaminate.contamination(docs, items).count() == 0
    assert decontaminate.contamination(frame(spark, ODD), items).where("n_hit > 0").count() == 0
    assert bpe.round_trip_digests(docs, bpe.vocabulary()).count() == 0
