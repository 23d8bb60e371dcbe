"""Document fingerprints by I-Match: terms of middling rarity, hashed in randomised lexicon subsets.

The lexicon holds the terms that between LEAST and MOST of all documents have. A subset
keeps each of its terms with a probability of 1 / 2^level, by a hash of the term; a text's
terms in a subset are sorted and hashed together, so a subset tells two texts apart exactly
if a term that only one of them has is in it. One rate can't fit texts of 5 and 20,000
words: a text uses the SUBSETS subsets of the level at which one or two of its words fall
in each, and those of the next level, so texts whose word counts differ by less than a
factor of two share a level.

A fingerprint is a list of tokens of 8 hex digits, one for each subset in which the text has
terms: level, subset, and 16 bits of the terms' hash. In a text whose subsets hold no term of
the lexicon (a few common words, or one of very many copies, whose terms are frequent for
that) all of its words count; a text without words has one token of its own.

Everything is Column code. The lexicon is at most (distinct terms a document) / LEAST terms
whatever the number of documents; it is broadcast up to LEXICON_ROWS terms and joined by a
shuffle beyond, with equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, written
from .ordering import Ranges

#: Shares of all documents between which a term's documents must lie.
LEAST = 1 / 10_000
MOST = 1 / 100
#: Subsets of each level.
SUBSETS = 32
#: Terms (8 bytes each) up to which the lexicon is sent to all tasks.
LEXICON_ROWS = 2_000_000


def terms(text: Column) -> Column:
    """Hashes of the distinct words (letters and digits, in lower case) of a text, ascending."""
    words = F.array_except(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(F.lit("")))
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, total: int, least: float = LEAST, most: float = MOST) -> DataFrame:
    """term: the hashes of the terms that a share of ``least`` to ``most`` of the texts have."""
    having = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    share = F.col("count") / F.lit(float(max(1, total)))
    # A term of a single text is rare, not frequent, in small corpora too.
    return having.where((share >= least) & ((share <= most) | (F.col("count") == 1))).select("term")


def _dealt(found: Column, level: Column) -> Column:
    """Array of (slot, term) of the subsets of one level; slot is level * 256 + subset."""

    def all_rounds(parts: Column) -> Column:
        def slot(seed: Column, term: Column) -> Column:
            return level * 256 + seed * parts + F.xxhash64(seed, term).bitwiseAND(parts - 1)

        def one_round(seed: Column) -> Column:
            pairs = F.transform(found, lambda term: F.struct(slot(seed, term).alias("slot"), term.alias("term")))
            return F.filter(pairs, lambda pair: pair["slot"] < level * 256 + SUBSETS)

        rounds = F.greatest(F.lit(1).cast("long"), F.lit(SUBSETS) / parts).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), one_round))

    return let(F.pow(F.lit(2), level).cast("long"), all_rounds)


def subset_terms(found: Column) -> Column:
    """(slot, term) of the two levels of a text with these terms, before the lexicon is looked at."""

    def both(found: Column, level: Column) -> Column:
        return F.concat(*(let(x, lambda level: _dealt(found, level)) for x in (level, level + 1)))

    def level(found: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(found), F.lit(1)))).cast("int") - 1)

    return let(found, lambda found: let(level(found), lambda level: both(found, level)))


def _token(slot: Column, value: Column) -> Column:
    code = slot * 65_536 + value.bitwiseAND(F.lit(65_535))
    return F.lpad(F.lower(F.hex(code)), 8, "0")


def fingerprint_of(entries: Column, bare: Column) -> Column:
    """The tokens of (slot, term, known); one token of ``bare`` (a hash of all words) if there are none.

    Entries that aren't known to the lexicon count if no other is there.
    """

    def chosen(every: Column) -> Column:
        inside = F.filter(every, lambda p: p["known"])
        return F.sort_array(F.array_distinct(F.when(F.size(inside) > 0, inside).otherwise(every)))

    def token(ordered: Column, slot: Column) -> Column:
        own = F.transform(F.filter(ordered, lambda p: p["slot"] == slot), lambda p: p["term"])
        return _token(slot, F.xxhash64(own))

    def tokens(ordered: Column) -> Column:
        slots = F.array_distinct(F.transform(ordered, lambda p: p["slot"]))
        return F.array_join(F.transform(slots, lambda slot: token(ordered, slot)), " ")

    alone = F.concat(F.lit("ffff"), F.substring(F.lpad(F.lower(F.hex(bare)), 16, "0"), 1, 12))
    return F.when(F.size(entries) == 0, alone).otherwise(let(entries, lambda every: let(chosen(every), tokens)))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: of the subsets, on levels that both fingerprints have, in which either has
    terms, the share in which both have the same. Equal fingerprints have likeness 1."""

    def level(token: Column) -> Column:
        return F.substring(token, 1, 2)

    def levels(tokens: Column) -> Column:
        return F.array_distinct(F.transform(tokens, level))

    def slots(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.substring(t, 1, 4))

    def share(a: Column, b: Column) -> Column:
        either = F.size(F.array_union(slots(a), slots(b)))
        return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)

    def on(both: Column, a: Column, b: Column) -> Column:
        a, b = (F.filter(x, lambda t: F.array_contains(both, level(t))) for x in (a, b))
        return let(a, lambda a: let(b, lambda b: share(a, b)))

    def of(a: Column, b: Column) -> Column:
        return let(F.array_intersect(levels(a), levels(b)), lambda both: on(both, a, b))

    found = let(F.split(one, " "), lambda a: let(F.split(other, " "), lambda b: of(a, b)))
    return F.when(one == other, 1.0).otherwise(found)


def _in_lexicon(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``known``: whether ``term`` is in the lexicon."""
    marked = known.withColumn("known", F.lit(True))
    if known.limit(LEXICON_ROWS + 1).count() <= LEXICON_ROWS:
        marked = F.broadcast(marked)
    return rows.join(marked, "term", "left")


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str], known: DataFrame) -> DataFrame:
    """``keys`` and a fingerprint for each of ``texts`` (result column -> text column).

    keys: columns that tell all rows apart. Null texts give null fingerprints. If ``rows``
    are dealt by a column among the keys, they aren't shuffled again.
    """
    sides = list(texts)
    listed = rows.select(*keys, *(terms(F.col(column)).alias(f"_terms{i}") for i, column in enumerate(texts.values())))
    bare = [f"_bare{i}" for i in range(len(sides))]  # null where the text is
    hashed = listed.withColumns(
        {b: F.when(F.col(f"_terms{i}").isNotNull(), F.xxhash64(f"_terms{i}")) for i, b in enumerate(bare)}
    )

    def sided(i: int) -> Column:
        return F.transform(
            subset_terms(F.col(f"_terms{i}")),
            lambda p: F.struct(F.lit(i).alias("side"), p["slot"].alias("slot"), p["term"].alias("term")),
        )

    empty = F.array().cast("array<struct<side:int,slot:bigint,term:bigint>>")
    every = F.concat(*(F.coalesce(sided(i), empty) for i in range(len(sides))))
    names = [*keys, *bare]
    single = hashed.select(*names, F.explode_outer(every).alias("_p")).select(*names, "_p.*")
    kept = _in_lexicon(single, known)
    entry = F.struct("slot", "term", F.col("known").isNotNull().alias("known"))
    lists = [F.collect_list(F.when(F.col("side") == i, entry)).alias(f"_list{i}") for i in range(len(sides))]
    grouped = kept.groupBy(*names).agg(*lists)
    made = [
        F.when(F.col(bare[i]).isNotNull(), fingerprint_of(F.col(f"_list{i}"), F.col(bare[i]))).alias(side)
        for i, side in enumerate(sides)
    ]
    return grouped.select(*keys, *made)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null texts count as empty, repeated rows give equal rows."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = written(lexicon(texts, texts.count()))
    distinct = texts.groupBy("doc_id", "text").count()
    found = fingerprints(
        distinct.withColumn("_id", F.sha2("text", 256)).select("doc_id", "text", "_id", "count"),
        ["doc_id", "_id", "count"],
        {"fingerprint": "text"},
        known,
    )
    return found.select("doc_id", "fingerprint", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("col")


def beside_next(docs: DataFrame) -> DataFrame:
    """Every row (doc_id, text) with ``next``, the text that follows in descending order of doc_id,
    and ``bucket`` and ``place``, which number the rows; the last row is followed by the first.

    Null ids come last; rows that repeat an id follow each other by a hash of the text. Texts
    are dealt once, by ranges of the order; a range's last row finds its successor in a copy
    of the next range's first row, which is marked ``copy``.
    """
    keyed = docs.select("doc_id", "text").withColumns(
        {
            "none": F.col("doc_id").isNull(),
            "down": F.bitwise_not(F.col("doc_id").cast("long")),
            "h1": F.xxhash64("text"),
            "h2": F.xxhash64(F.lit("second"), "text"),
        }
    )
    names = ["none", "down", "h1", "h2"]
    keys = written(keyed.select(*names))
    ranges = Ranges(keys, names)
    firsts = (
        keys.groupBy(ranges.number().alias("bucket")).agg(F.min(F.struct(*names)).alias("key")).orderBy("bucket").collect()
    )  # a row for each range
    after = [(row["bucket"], *firsts[(i + 1) % len(firsts)]["key"]) for i, row in enumerate(firsts)]
    wanted = docs.sparkSession.createDataFrame(after, "bucket int, none_ boolean, down_ long, h1_ long, h2_ long")
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    copies = (
        keyed.join(F.broadcast(wanted), same[0] & same[1] & same[2] & same[3])
        .drop("none_", "down_", "h1_", "h2_")
        .dropDuplicates(["bucket"])
        .withColumn("copy", F.lit(True))
    )
    rows = keyed.withColumns({"bucket": ranges.number(), "copy": F.lit(False)}).unionByName(copies)
    order = Window.partitionBy("bucket").orderBy("copy", *names)
    return rows.select(
        "bucket",
        F.row_number().over(order).alias("place"),
        "copy",
        "doc_id",
        "text",
        F.lead("text").over(order).alias("next"),
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (last third replaced by the next text's start)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = written(lexicon(texts, texts.count()))
    moved = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - moved), F.substring(F.col("next"), F.lit(1), moved)
    )
    rows = (
        beside_next(texts)
        .withColumn("edited", F.when(~F.col("copy"), edited))
        .withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    )
    keys = ["bucket", "place", "copy", "doc_id", "n_chars", "edited_sha256"]
    found = fingerprints(rows, keys, {"fingerprint": "text", "edited_fingerprint": "edited"}, known)
    order = Window.partitionBy("bucket").orderBy("place")
    follows = found.withColumn("_next", F.lead("fingerprint").over(order)).where(~F.col("copy"))
    return follows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
