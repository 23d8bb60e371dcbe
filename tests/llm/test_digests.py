"""Document fingerprints, whitening and the Merkle manifest against brute force."""

import hashlib
import random
import string
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sentiweave.llm import imatch, merkle, ordering, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    rare = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(3_000)]
    rows = [(i, prose(rng, common * 200 + rare, rng.choice([3, 20, 80, 400]))) for i in range(0, 600, 2)]
    copied = prose(rng, rare, 60)
    rows += [(1_000 + i, copied) for i in range(200)]  # a group of copies that holds a third
    rows += [(5_000, None), (5_001, ""), (5_002, "  \n "), (5_003, "ÄÖ ß 語 語"), (5_004, prose(rng, rare, 30_000))]
    rows += [(7_000, "same id one"), (7_000, "same id two"), (7_000, "same id two"), (None, "no id"), (None, None)]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", None, ""]), None if i is None else f"s{i % 3}", None if t is None else len(t)) for i, t in rows]


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def long_hash(value, seed=42):
    return xx((value & (1 << 64) - 1).to_bytes(8, "little"), seed)


def terms(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]
    return sorted({signed(xx(w.encode())) for w in words})


def brute_fingerprint(text, known):
    found = terms(text)
    level = max(0, int(np.ceil(np.log2(max(1, len(found))))) - 1)
    pairs = set()
    for lv in (level, level + 1):
        parts = 2**lv
        for seed in range(max(1, imatch.SUBSETS // parts)):
            start = xx(seed.to_bytes(4, "little"))
            for t in found:
                slot = seed * parts + (long_hash(t, start) & (parts - 1))
                if slot < imatch.SUBSETS:
                    pairs.add((lv * 256 + slot, t))
    inside = {p for p in pairs if p[1] in known} or pairs
    tokens = []
    for slot in sorted({s for s, _ in inside}):
        value = 42
        for t in sorted(t for s, t in inside if s == slot):
            value = long_hash(t, value)
        tokens.append(f"{slot * 65_536 + (value & 65_535):08x}")
    return " ".join(tokens)


def test_imatch(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = imatch.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    texts = [t or "" for _, t, *_ in rows]
    having = {}
    for t in texts:
        for term in terms(t):
            having[term] = having.get(term, 0) + 1
    known = {t for t, n in having.items() if n == 1 or imatch.LEAST <= n / len(rows) <= imatch.MOST}
    # Rows of one id follow each other in the order of their texts' hashes.
    key = lambda r: (r[0] is None, -(r[0] or 0), signed(xx((r[1] or "").encode())))
    ordered = sorted(rows, key=key)
    expected = []
    for i, (doc_id, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        expected.append(
            (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(),
             *(brute_fingerprint(t, known) if terms(t) else None for t in (text, edited)))
        )
    no_words = lambda f: None if f.startswith("ffff") else f
    found = [(r.doc_id, r.n_chars, r.edited_sha256, no_words(r.fingerprint), no_words(r.edited_fingerprint)) for r in got]
    order = lambda r: [(x is None, x or 0) if i < 2 else str(x) for i, x in enumerate(r)]
    assert sorted(found, key=order) == sorted(expected, key=order)
    by_id = {r.doc_id: r for r in got}
    copies = {by_id[i].fingerprint for i in range(1_000, 1_200)}
    assert len(copies) == 1 and by_id[1_100].near_next == 1.0 and 0.2 < by_id[1_100].near_edited < 1
    long = [r for r in got if r.n_chars > 300 and (r.doc_id or 0) < 600]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.02 > np.mean([r.near_next for r in long])
    assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))
    assert by_id[5_001].fingerprint == by_id[5_002].fingerprint != by_id[5_003].fingerprint


def test_imatch_small_tables(spark):
    docs = spark.createDataFrame([(1, "alone in the table", 3)], "doc_id long, text string, bucket int")
    (row,) = imatch.edited_likeness(docs).collect()
    assert row.near_next == 1.0 and row.n_chars == 18
    assert row.edited_sha256 == hashlib.sha256(b"alone in the" + b"alone ").hexdigest()
    empty = docs.limit(0)
    assert imatch.edited_likeness(empty).collect() == []
    assert imatch.document_fingerprints(empty).collect() == []


def test_imatch_without_broadcast(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in corpus(5)]
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string")
    one = sorted((str(r.doc_id), r.fingerprint) for r in imatch.document_fingerprints(docs).collect())
    monkeypatch.setattr(imatch, "LEXICON_ROWS", 10)
    assert one == sorted((str(r.doc_id), r.fingerprint) for r in imatch.document_fingerprints(docs).collect())
    assert len(one) == len(rows) + 5


def test_likeness(spark):
    pairs = [("05010001 05020002", "05010001 05020003", 0.5), ("05010001 06020002", "06020002 07010001", 1.0),
             ("05010001", "09010001", 0.0), ("ffffabc", "ffffabc", 1.0), ("ffffabc", "ffffabd", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, likeness double")
    for row in df.withColumn("got", imatch.likeness(F.col("a"), F.col("b"))).collect():
        assert row.got == row.likeness, row


def test_positions(spark):
    rng = random.Random(2)
    rows = [("a", rng.randrange(50) or None, f"{i:04}'\\\"") for i in range(3_000)] + [("", 1, "x"), ("b", None, "é")]
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(5)
    got = ordering.with_positions(df, "g", ["k", "t"]).collect()
    for group in ("a", "", "b"):
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode()))
        assert [tuple(r)[:3] for r in sorted((r for r in got if r.g == group), key=lambda r: r.position)] == own
        assert {r.size for r in got if r.g == group} == {len(own)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        start = i // 8 * 8
        run = level[start : start + 8]
        yield run[: i - start], run[i - start + 1 :]
        i //= 8


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_proofs(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def leaf(row, text):
        doc_id, _, lang, source, n_chars = row
        return sha("".join(map(encoded, (doc_id, source, lang, n_chars, text))))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for j, g in enumerate(names):
        for i, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = [*steps(trees[g], i), *steps(top, j)]
            text, doc_id = row[1], row[0]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = text.translate(lower)
            node = leaf(row, text)
            for before, after in way:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(s for before, after in way for s in before + after))
            yield doc_id, own, trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]


@pytest.mark.parametrize("rows", [
    corpus(),
    [(i, f"Text {i}", f"l{i % 70}", None, 1) for i in range(900)],  # a tree of groups with two levels
    [(i, f"Text {i}", "en", "s", i) for i in range(8**4 + 1)],  # one more than whole subtrees
    [(4, "ABC", None, None, None)],
    [(4, "ABC", "", None, None), (5, None, None, None, None)],
])
def test_merkle(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"group": F.lit(7), "size": F.lit("x"), "a.b": F.lit(1)})
    got = sorted(map(str, map(tuple, merkle.document_proofs(docs.repartition(5)).collect())))
    assert got == sorted(map(str, brute_proofs(rows)))


def test_merkle_manifest(spark):
    rows = [(i, f"{i:064x}") for i in range(600)]
    leaves = spark.createDataFrame(rows, "id long, digest string").withColumn("group", F.lit("g"))
    found = merkle.manifest(leaves, "id")
    assert [nodes.count() for nodes in found.levels] == [600, 2, 1]
    proofs = found.proofs()
    assert {r[0] for r in proofs.select(merkle.folded(F.col("digest"), F.col("path"))).distinct().collect()} == {found.root()}
    empty = merkle.manifest(leaves.limit(0), "id")
    assert empty.root() is None and empty.proofs().collect() == []


def reference_whitening(rows):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    size = max({len(v) for _, v in usable}, key=lambda s: (len({tuple(v) for _, v in usable if len(v) == s}), s))
    usable = [(i, v) for i, v in usable if len(v) == size]
    x = np.floor(64 * np.array([v for _, v in usable], np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = (n * fit - total).astype(np.float64) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    keep = [k for k in np.argsort(-values)[:16] if values[k] > 1e-9 * max(values.max(), 1e-300)]
    whitened = (n * x - total).astype(np.float64) / n @ vectors[:, keep] / np.sqrt(values[keep])
    return usable, n, ((n * x - total) ** 2).sum(1), whitened, values[keep] / np.trace(v)


def check_whitening(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], schema).withColumn("x", F.lit("clash"))
    got = whitening.whiten(table.repartition(5)).toPandas()
    usable, n, deviation, whitened, explained = reference_whitening(rows)
    k = len(explained)
    assert len(got) == len(usable) * k and set(got.n) == {n}
    ids = sorted(range(len(usable)), key=lambda j: usable[j][0])
    got = got.sort_values(["vec_id", "component"], kind="stable")
    assert got.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == deviation[ids].tolist()
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    values = got.whitened.to_numpy().reshape(-1, k)
    signs = np.sign((values * whitened[ids]).sum(0))
    return np.abs(values * signs - whitened[ids]).max(axis=0)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=24) * np.linspace(3, 0.5, 24)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1_000 + i, rows[0][1]) for i in range(300)]  # copies
    odd = [None, [], [None] + [1.0] * 23, [float("nan")] + [0.0] * 23, [float("inf")] + [0.0] * 23, [1.0, 2.0], [0.0] * 24]
    rows += [(5_000 + i, v) for i, v in enumerate(odd)]
    assert (check_whitening(spark, rows) < 1e-8).all()


def test_whitening_of_few_dimensions_and_low_rank(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-40, 40, size=(200, 3)) / 64
    rows = [(i, [*v, v[0] + v[1], 2 * v[2]]) for i, v in enumerate(base.tolist())]
    wide = "vec_id long, embedding array<double>, label int"
    assert len(check_whitening(spark, rows, wide)) == 3  # the rank
    equal = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    assert whitening.whiten(equal).collect() == []
    assert whitening.whiten(equal.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(huge).collect()
    assert {r.deviation is None for r in found if r.vec_id < 3} == {True}  # doesn't fit a long
    assert all(np.isfinite(r.whitened) for r in found)


def test_spectrum():
    rng = np.random.default_rng(6)
    for values in ([5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0], [1, 1 + 1e-9, 1 - 1e-9, 1e-8, 0, 0], [2] * 8, [1e6, 1, 1e-3]):
        q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
        v = (q * np.array(values, float)) @ q.T
        v = (v + v.T) / 2
        assert whitening.inertia(v - 1.5 * np.eye(len(v))) == (sum(x > 1.5 for x in values), sum(x < 1.5 for x in values))
        found, vectors = whitening.Spectrum(v).pairs(16)
        expected = sorted((x for x in values if x > 1e-12), reverse=True)
        assert np.allclose(found, expected, rtol=0, atol=1e-12 * max(values))
        assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-10)
        assert np.abs(v @ vectors - vectors * found).max() < 1e-11 * max(values)
