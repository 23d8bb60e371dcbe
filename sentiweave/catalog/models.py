"""Language identification, classifier, scoring, declared studies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.catalog.registry import (
    NWS,
    WS,
    Query,
    register,
    sql_round,
    sql_strip,
    table,
    toxic_corpus,
)
from sentiweave.catalog.statistics import _LOGITS_SQL, _halves
from sentiweave.functions.numeric import prediction_columns, round_to, with_softmax
from sentiweave.functions.text import NWS as JAVA_NWS
from sentiweave.functions.text import WS as JAVA_WS
from sentiweave.functions.text import Tokenizer
from sentiweave.operators import langid
from sentiweave.operators.metrics import binary_metrics
from sentiweave.operators.ratios import sentiment_ratios
from sentiweave.plans import scoring, studies
from sentiweave.plans.bayes import BayesModel
from sentiweave.plans.embedding import embedding_scorer, fit_embedding
from sentiweave.plans.inference import score_by_length
from sentiweave.plans.prepare import preprocess
from sentiweave.plans.selection import f1_by_threshold, select_threshold
from sentiweave.plans.training import TrainingOptions, evaluate, fit_classifier, tokenized, word_ids
from sentiweave.sources.corpora import training_rows

CATALOG: dict[str, Query] = {}

_GRAMS = f"""padded AS (
  SELECT doc_id, lang,
         string_split(' ' || trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')) || ' ', '') AS c
  FROM documents WHERE regexp_matches(text, '{NWS}')),
places AS (SELECT doc_id, lang, c, unnest(range(1, len(c) - 1)) AS i FROM padded),
grams AS (SELECT doc_id, lang, c[i] || c[i + 1] || c[i + 2] AS gram FROM places),
counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL),
kept AS (SELECT * FROM counts
         QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 2000),
profiles AS (
  SELECT lang, gram, n,
         round_even(ln(n::DOUBLE / sum(n) OVER (PARTITION BY lang)::DOUBLE) * 1000, 0)::BIGINT AS weight
  FROM kept)"""

_DETECTED = f"""{_GRAMS},
lowest AS (SELECT min(weight) - 1000 AS missing FROM profiles),
languages AS (SELECT DISTINCT lang FROM profiles),
terms AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
scores AS (
  SELECT doc_id, l.lang AS lang, sum(tf * coalesce(weight, missing)) AS score, count(p.gram) AS known
  FROM terms CROSS JOIN languages l CROSS JOIN lowest
  LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = terms.gram
  GROUP BY ALL),
detected AS (
  SELECT doc_id, CASE WHEN sum(known) OVER (PARTITION BY doc_id) > 0 THEN lang END AS detected FROM scores
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""


#: Trigrams per language in the registered queries' profiles.
_TOP_GRAMS = 2_000


def _fit(spark: SparkSession, sf_dir: str) -> langid.LanguageProfiles:
    return langid.LanguageProfiles.fit(
        table(spark, sf_dir, "documents"), "text", "lang", grams_per_language=_TOP_GRAMS
    )


@register(CATALOG, f"WITH {_GRAMS} SELECT lang, gram, n, weight FROM profiles")
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_profiles(
        table(spark, sf_dir, "documents"), "text", "lang", grams_per_language=_TOP_GRAMS
    )


# Every document, and what no profile knows: its digits, and its letters as Cyrillic ones.
_CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщы")
_HARD = f"""hard AS (
  SELECT doc_id * 3 AS doc_id, lang, text FROM documents
  UNION ALL SELECT doc_id * 3 + 1, lang, '12345 ' || doc_id FROM documents
  UNION ALL SELECT doc_id * 3 + 2, lang, translate(lower(text), '{_CYRILLIC[0]}', '{_CYRILLIC[1]}')
  FROM documents)"""
_HARD_DETECTED = _DETECTED.replace("terms AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL)", f"""{_HARD},
hard_padded AS (
  SELECT doc_id, string_split(' ' || trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')) || ' ', '') AS c
  FROM hard WHERE regexp_matches(text, '{NWS}')),
hard_places AS (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM hard_padded),
terms AS (SELECT doc_id, c[i] || c[i + 1] || c[i + 2] AS gram, count(*) AS tf FROM hard_places GROUP BY ALL)""")


def _hard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    digits = F.concat(F.lit("12345 "), F.col("doc_id").cast("string"))
    foreign = F.translate(F.lower("text"), *_CYRILLIC)
    parts = F.array(F.col("text"), digits, foreign)
    return docs.select("doc_id", "lang", F.posexplode(parts).alias("_n", "text")).select(
        (F.col("doc_id") * 3 + F.col("_n")).alias("doc_id"), "lang", "text"
    )


@register(
    CATALOG,
    f"""WITH {_HARD_DETECTED}
    SELECT doc_id, lang, detected FROM hard LEFT JOIN detected USING (doc_id)""",
)
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = _fit(spark, sf_dir).detect(F.col("text"))
    return _hard_documents(spark, sf_dir).select("doc_id", "lang", detected.alias("detected"))


@register(
    CATALOG,
    f"""WITH {_DETECTED}
    SELECT doc_id, lang, text FROM documents JOIN detected USING (doc_id) WHERE detected = 'es'""",
)
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return langid.filter_language(docs, "es", _fit(spark, sf_dir))


@register(
    CATALOG,
    f"""WITH {_DETECTED},
    first AS (
      SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '{NWS}')
      QUALIFY row_number() OVER (
        PARTITION BY lang, lower({sql_strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")})
        ORDER BY doc_id) = 1)
    SELECT doc_id, lang FROM first JOIN detected USING (doc_id) WHERE detected = lang""",
)
def preprocess_with_language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = preprocess(
        docs,
        F.col("lang"),
        id_column="doc_id",
        within=("lang",),
        profiles=_fit(spark, sf_dir),
    )
    return rows.select("doc_id", "lang")


_SOFTMAX = """z AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
e AS (SELECT vec_id, [exp(x - list_max(v)) FOR x IN v] AS e FROM z),
p AS (SELECT vec_id, [x / list_sum(e) FOR x IN e] AS p FROM e)"""
_PREDICTED = f"""(list_position(p, list_max(p)) - 1)::INTEGER AS sentiment_label,
  {sql_round("p[2]", 6)} AS sentiment_score, {sql_round("list_max(p)", 6)} AS confidence"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: round_to(F.col(c), 6) for c in ("sentiment_score", "confidence")}
    )


@register(CATALOG, f"WITH {_SOFTMAX} SELECT vec_id, {_PREDICTED} FROM p")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_softmax(table(spark, sf_dir, "embeddings"), "embedding")
    scored = rows.withColumns(prediction_columns(F.col("probabilities")))
    return _rounded(scored.select("vec_id", "sentiment_label", "sentiment_score", "confidence"))


@register(
    CATALOG,
    f"""WITH {_SOFTMAX}
    SELECT doc_id, lang, source AS topic, text, {_PREDICTED}
    FROM documents JOIN p ON doc_id = vec_id""",
)
def predict_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("logits")
    )
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("source").alias("topic"), "text"
    )
    scored = scoring.predict_corpus(docs.join(vectors, "doc_id"), scoring.logits_scorer("logits"))
    return _rounded(scored.drop("logits"))


def _classifier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows(
        toxic_corpus(spark, sf_dir), "text", "sentiment", F.col("lang"), keep=["doc_id"]
    )


# Rows are told apart by the first digit of an md5 of their id: a quarter is held out.
_HELD_OUT = "md5(doc_id::VARCHAR)[1] < '4'"


def _held_out():
    return F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "4"


@register(
    CATALOG,
    """SELECT doc_id, lang, source AS topic, text, true AS label_agrees, true AS in_range
    FROM documents""",
)
def predict_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solver is iterative: what SQL can state of its scores is checked for every row."""
    model = fit_classifier(_classifier_rows(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("source").alias("topic"), "text"
    )
    scored = scoring.predict_corpus(docs, scoring.model_scorer(model))
    label, positive, sure = (F.col(c) for c in ("sentiment_label", "sentiment_score", "confidence"))
    agrees = (label == (positive > 0.5).cast("int")) & (
        F.abs(sure - F.greatest(positive, 1 - positive)) < 1e-9
    )
    in_range = label.isin(0, 1) & positive.between(0, 1) & sure.between(0.5, 1)
    return scored.select(*docs.columns, agrees.alias("label_agrees"), in_range.alias("in_range"))


@register(
    CATALOG,
    f"""SELECT 'val_' || lang || '_eval_' || k AS metric, true AS in_range
    FROM (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id)
          WHERE {_HELD_OUT} AND toxic IN (0, 1) AND regexp_matches(text, '{NWS}')),
         (VALUES ('accuracy'), ('precision'), ('recall'), ('f1')) AS v(k)""",
)
def train_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model selection over two settings, metrics per language on held-out rows."""
    rows = _classifier_rows(spark, sf_dir)
    options = TrainingOptions(regularization=(0.01, 0.1))
    model = fit_classifier(rows.where(~_held_out()), options, "doc_id")
    found = evaluate(model, rows.where(_held_out()))
    return found.select("metric", F.col("value").between(0, 1).alias("in_range"))


def _network():
    """A small fixed network on whole numbers: two embeddings, summed, rectified, two classes."""

    def logits(ids, mask):
        one = np.where(mask, ids * 7919 % 1013 - 506, 0).sum(axis=1)
        two = np.where(mask, ids * 9973 % 997 - 498, 0).sum(axis=1)
        one, two = np.maximum(one, 0), np.maximum(two, 0)
        return np.stack([one - 2 * two, 3 * two - one], axis=1)

    return logits


@register(
    CATALOG,
    f"""WITH t AS (SELECT doc_id, lang,
           [('0x' || md5(x)[1:8])::BIGINT % 65536 FOR x IN regexp_extract_all(coalesce(text, ''), '{NWS}+')] AS ids
         FROM documents),
    h AS (SELECT *, greatest(coalesce(list_sum([x * 7919 % 1013 - 506 FOR x IN ids]), 0), 0) AS one,
                 greatest(coalesce(list_sum([x * 9973 % 997 - 498 FOR x IN ids]), 0), 0) AS two FROM t)
    SELECT doc_id, lang, (one - 2 * two)::BIGINT AS zero_class, (3 * two - one)::BIGINT AS one_class,
           (3 * two - one > one - 2 * two)::INTEGER AS sentiment_label
    FROM h""",
)
def network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through an outside model, in padded batches of similar length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = docs.withColumn("ids", word_ids(F.coalesce("text", F.lit("")))).drop("text")
    scored = score_by_length(rows, "ids", _network)
    return with_softmax(scored, "logits").withColumns(prediction_columns(F.col("probabilities"))).select(
        "doc_id",
        "lang",
        F.get("logits", F.lit(0)).cast("long").alias("zero_class"),
        F.get("logits", F.lit(1)).cast("long").alias("one_class"),
        "sentiment_label",
    )


_BAYES = f"""train AS (
  SELECT text, 1 - toxic AS y FROM documents JOIN labels USING (doc_id)
  WHERE NOT {_HELD_OUT} AND toxic IN (0, 1)),
w AS (SELECT y, unnest(regexp_extract_all(lower(text), '{NWS}+')) AS word FROM train),
c AS (SELECT word, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0
      FROM w GROUP BY word),
s AS (SELECT (count(*) + sum(n1) + 1)::DOUBLE AS one, (count(*) + sum(n0) + 1)::DOUBLE AS zero FROM c),
weights AS (SELECT word, round_even(ln(((n1 + 1) / one) / ((n0 + 1) / zero)) * 1000, 0)::BIGINT AS weight
            FROM c CROSS JOIN s),
prior AS (SELECT round_even(ln((count(*) FILTER (WHERE y = 1) + 1)::DOUBLE
                               / (count(*) FILTER (WHERE y = 0) + 1)::DOUBLE) * 1000, 0)::BIGINT AS prior
          FROM train),
terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{NWS}+')) AS word FROM documents),
sums AS (SELECT doc_id, sum(coalesce(weight, round_even(ln(zero / one) * 1000, 0)::BIGINT)) AS total
         FROM terms LEFT JOIN weights USING (word) CROSS JOIN s GROUP BY doc_id),
bayes AS (SELECT doc_id, lang, (prior + coalesce(total, 0))::BIGINT AS log_odds
          FROM documents LEFT JOIN sums USING (doc_id) CROSS JOIN prior)"""


def _bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = docs.join(labels.select("doc_id", (1 - F.col("toxic")).alias("label")), "doc_id")
    model = BayesModel.fit(train.where(~_held_out()))
    return model.score(docs, "doc_id")


@register(
    CATALOG,
    f"""WITH {_BAYES}
    SELECT doc_id, log_odds, (log_odds > 0)::INTEGER AS sentiment_label,
           {sql_round("1 / (1 + exp(-greatest(least(log_odds / 1000.0::DOUBLE, 500), -500)))", 6)} AS sentiment_score
    FROM bayes""",
)
def bayes_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bayes(spark, sf_dir)
    return found.withColumn("sentiment_score", round_to(F.col("sentiment_score"), 6))


@register(
    CATALOG,
    f"""WITH {_BAYES}
    SELECT lang, count(*) AS n_rows,
           {sql_round("avg(((log_odds > 0)::INTEGER = 1 - toxic)::INTEGER::DOUBLE)", 6)} AS accuracy
    FROM bayes JOIN labels USING (doc_id) WHERE {_HELD_OUT} AND toxic IN (0, 1) GROUP BY lang""",
)
def bayes_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    truth = docs.select("doc_id", "lang").join(
        labels.where("toxic in (0, 1)").select("doc_id", (1 - F.col("toxic")).alias("label")), "doc_id"
    )
    rows = truth.where(_held_out()).join(_bayes(spark, sf_dir), "doc_id")
    found = binary_metrics(rows, "label", "sentiment_label", ["lang"])
    return found.select("lang", "n_rows", round_to(F.col("accuracy"), 6).alias("accuracy"))


@register(
    CATALOG,
    f"""WITH {_DETECTED}, {_BAYES.replace("terms", "word_terms")},
    first AS (
      SELECT doc_id, lang, source FROM documents WHERE regexp_matches(text, '{NWS}')
      QUALIFY row_number() OVER (
        PARTITION BY lang, lower({sql_strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")})
        ORDER BY doc_id) = 1)
    SELECT f.lang, source, {sql_round("avg((log_odds > 0)::INTEGER::DOUBLE)", 6)} AS positive_ratio,
           count(*) AS count
    FROM first f JOIN detected USING (doc_id) JOIN bayes USING (doc_id)
    WHERE detected = f.lang GROUP BY f.lang, source""",
)
def whole_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, drop copies, check the language, fit, score, and shares of positive rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = preprocess(
        docs, F.col("lang"), id_column="doc_id", within=("lang",), profiles=_fit(spark, sf_dir)
    )
    scored = rows.select("doc_id", "lang", "source").join(_bayes(spark, sf_dir), "doc_id")
    found = sentiment_ratios(scored, ["lang", "source"])
    return found.withColumn("positive_ratio", round_to(F.col("positive_ratio"), 6))


# The threshold is chosen on one part of the training rows, with a model fitted on the others.
_THRESHOLDS = [t * 1_000 for t in range(-40, 41, 4)]
_CHOICE = "md5(doc_id::VARCHAR)[2] < '4'"


def _choice():
    return F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 2, 1) < "4"


@register(
    CATALOG,
    f"""WITH {_BAYES.replace("WHERE NOT " + _HELD_OUT, f"WHERE NOT {_HELD_OUT} AND NOT {_CHOICE}")},
    rows AS (SELECT doc_id, lang, log_odds, 1 - toxic AS label, {_HELD_OUT} AS held
             FROM bayes JOIN labels USING (doc_id) WHERE toxic IN (0, 1)),
    f AS (SELECT t, count(*) FILTER (WHERE label = 0 AND log_odds <= t) AS tp,
                 count(*) FILTER (WHERE label = 1 AND log_odds <= t) AS fp,
                 count(*) FILTER (WHERE label = 0 AND log_odds > t) AS fn
          FROM rows, (SELECT unnest({_THRESHOLDS}) AS t) WHERE NOT held AND {_CHOICE} GROUP BY t),
    best AS (SELECT t FROM f ORDER BY CASE WHEN 2 * tp + fp + fn > 0
             THEN 2 * tp::DOUBLE / (2 * tp + fp + fn)::DOUBLE ELSE 0 END DESC, t LIMIT 1),
    m AS (SELECT lang, t AS threshold, count(*) AS n_rows,
                 count(*) FILTER (WHERE label = 0 AND log_odds <= t) AS tp,
                 count(*) FILTER (WHERE label = 1 AND log_odds <= t) AS fp,
                 count(*) FILTER (WHERE label = 0 AND log_odds > t) AS fn,
                 avg((label = (log_odds > t)::INTEGER)::INTEGER::DOUBLE) AS accuracy
          FROM rows, best WHERE held GROUP BY lang, t)
    SELECT lang, threshold::BIGINT AS threshold, n_rows, {sql_round("accuracy", 6)} AS accuracy,
           {sql_round("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn)::DOUBLE ELSE 0 END", 6)} AS f1
    FROM m""",
)
def selected_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model selection on F1 (of toxic texts): the best of 21 thresholds, measured per language on held-out rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.where("toxic in (0, 1)").select("doc_id", (1 - F.col("toxic")).alias("label")), "doc_id")
    model = BayesModel.fit(rows.where(~_held_out() & ~_choice()))
    scored = model.score(rows, "doc_id").select("doc_id", "log_odds").join(rows.select("doc_id", "lang", "label"), "doc_id")
    flipped = scored.withColumns({"truth": 1 - F.col("label"), "margin": -F.col("log_odds")})
    chosen = select_threshold(
        f1_by_threshold(flipped.where(~_held_out() & _choice()), "truth", "margin", [-t for t in _THRESHOLDS]), largest=True
    )
    guess = flipped.where(_held_out()).withColumn("guess", (F.col("margin") >= chosen).cast("int"))
    return binary_metrics(guess, "truth", "guess", ["lang"]).select(
        "lang",
        F.lit(-chosen).cast("long").alias("threshold"),
        "n_rows",
        round_to(F.col("accuracy"), 6).alias("accuracy"),
        round_to(F.col("f1"), 6).alias("f1"),
    )


@register(CATALOG)
def embedding_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per language of the embedding classifier on held-out rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    truth = labels.where("toxic in (0, 1)").select("doc_id", (1 - F.col("toxic")).alias("label"))
    rows = docs.join(truth, "doc_id").select("doc_id", "lang", F.col("source").alias("topic"), "text", "label")
    model = fit_embedding(rows.where(~_held_out()), "doc_id")
    held = rows.where(_held_out())
    scored = scoring.predict_corpus(held, embedding_scorer(model, held))
    return binary_metrics(scored, "label", "sentiment_label", ["lang"])


# Frequent words of the four languages stand in for aspect keywords.
_ASPECTS = {"article": ["the", "der", "el", "le"], "link": ["and", "und", "y", "et"], "rest": ["zzz"]}
_TAGS_SQL = " || ".join(
    f"CASE WHEN list_has_any(w, {terms}) THEN ['{aspect}'] ELSE [] END"
    for aspect, terms in _ASPECTS.items()
)


@register(
    CATALOG,
    f"""WITH t AS (
      SELECT lang, source AS topic, quality::DOUBLE AS sentiment_score,
             string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS w
      FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT lang, topic, sentiment_score, unnest({_TAGS_SQL}) AS aspect FROM t)
    SELECT aspect, lang, {sql_round("avg(sentiment_score)", 6)} AS mean_score, count(*) AS n_posts
    FROM g GROUP BY aspect, lang""",
)
def aspect_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    posts = docs.join(labels, "doc_id").select(
        "lang",
        F.col("source").alias("topic"),
        F.col("quality").cast("double").alias("sentiment_score"),
        studies.tag_aspects(F.col("text"), _ASPECTS).alias("aspects"),
    )
    found = studies.aspect_sentiment(posts, list(_ASPECTS))
    return found.withColumn("mean_score", round_to(F.col("mean_score"), 6))


@register(
    CATALOG,
    f"""WITH t AS (SELECT lang, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b
                  FROM documents JOIN labels USING (doc_id))
    SELECT lang, {sql_round("avg(a)", 6)} AS native_score, {sql_round("avg(b)", 6)} AS translated_score,
           {sql_round("avg(a - b)", 6)} AS gap, count(*) AS n_posts
    FROM t GROUP BY lang""",
)
def native_vs_translated_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    native = docs.join(labels, "doc_id").select(
        "doc_id", "lang", F.col("quality").cast("double").alias("sentiment_score")
    )
    translated = labels.select("doc_id", (1.0 - F.col("toxic")).alias("sentiment_score"))
    gap = studies.translation_gap(native, translated, "doc_id")
    columns = ("native_score", "translated_score", "gap")
    return gap.withColumns({c: round_to(F.col(c), 6) for c in columns})


@register(
    CATALOG,
    f"""SELECT lang, source, count(*) AS n_rows,
           {sql_round("avg((quality = 1 - toxic)::INTEGER::DOUBLE)", 6)} AS accuracy,
           {sql_round("coalesce(sum((quality = 1 AND toxic = 0)::INTEGER)::DOUBLE / nullif(sum((toxic = 0)::INTEGER), 0)::DOUBLE, 0)", 6)} AS precision,
           {sql_round("coalesce(sum((quality = 1 AND toxic = 0)::INTEGER)::DOUBLE / nullif(sum((quality = 1)::INTEGER), 0)::DOUBLE, 0)", 6)} AS recall
    FROM documents JOIN labels USING (doc_id) GROUP BY lang, source""",
)
def gold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("label")
    )
    guesses = labels.select("doc_id", (1 - F.col("toxic")).alias("sentiment_label"))
    found = studies.gold_accuracy(guesses, gold, ["lang", "source"], "doc_id").drop("f1")
    return found.withColumns(
        {c: round_to(F.col(c), 6) for c in ("accuracy", "precision", "recall")}
    )


_TEMPERATURES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        _halves(F.col("embedding")).alias("logits"),
        (F.col("label") >= 5).cast("int").alias("label"),
    )
    return vectors.join(docs, "vec_id")


_LOSSES = f"""t AS (
  SELECT lang, {_LOGITS_SQL} AS z, (label >= 5)::INTEGER AS y, temperature::DOUBLE AS temperature
  FROM embeddings JOIN documents ON vec_id = doc_id,
       (SELECT unnest({_TEMPERATURES}) AS temperature)),
losses AS (
  SELECT lang, temperature, count(*) AS n_rows,
         avg(ln(exp(z[1] / temperature) + exp(z[2] / temperature)) - z[y + 1] / temperature) AS nll
  FROM t GROUP BY lang, temperature)"""


@register(
    CATALOG,
    f"WITH {_LOSSES} SELECT lang, temperature, {sql_round('nll', 6)} AS nll, n_rows FROM losses",
)
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = studies.nll_by_temperature(
        _calibration(spark, sf_dir), "logits", "label", ["lang"], _TEMPERATURES
    )
    return losses.withColumn("nll", round_to(F.col("nll"), 6))


@register(
    CATALOG,
    f"""WITH {_LOSSES}
    SELECT lang, arg_min(temperature, nll) AS temperature, {sql_round("min(nll)", 6)} AS nll
    FROM losses GROUP BY lang""",
)
def fitted_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = studies.fit_temperature(
        _calibration(spark, sf_dir), "logits", "label", ["lang"], _TEMPERATURES, refine=False
    )
    return best.withColumn("nll", round_to(F.col("nll"), 6))


# A subword stand-in: pieces of up to four characters.
_PIECES = Tokenizer(
    split=lambda text: F.regexp_extract_all(text, F.lit(f"({JAVA_NWS}{{1,4}})")),
    join=lambda tokens: F.array_join(tokens, ""),
)


@register(
    CATALOG,
    f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '{NWS}+')) AS word FROM documents),
    p AS (SELECT lang, (length(word) + 3) // 4 AS pieces FROM w)
    SELECT lang, count(*) AS n_words, sum(pieces)::BIGINT AS n_subwords,
           {sql_round("sum(pieces)::DOUBLE / count(*)::DOUBLE", 6)} AS subwords_per_word,
           {sql_round("count(*) FILTER (WHERE pieces > 1)::DOUBLE / count(*)::DOUBLE", 6)}
             AS fragmentation_rate,
           max(pieces)::BIGINT AS max_subwords
    FROM p GROUP BY lang""",
)
def token_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = studies.token_fragmentation(docs, "text", ["lang"], _PIECES)
    return found.withColumns(
        {c: round_to(F.col(c), 6) for c in ("subwords_per_word", "fragmentation_rate")}
    ).withColumn("max_subwords", F.col("max_subwords").cast("long"))


@register(
    CATALOG,
    """WITH f AS (SELECT lang, temperature::DOUBLE AS first FROM ("""
    + f"""WITH {_LOSSES} SELECT lang, arg_min(temperature, nll) AS temperature FROM losses
      GROUP BY lang)),
    r AS (SELECT lang, """
    + f"""{_LOGITS_SQL} AS z, (label >= 5)::INTEGER AS y, first * pow(2.5::DOUBLE, i / 10) AS t
      FROM embeddings JOIN documents ON vec_id = doc_id JOIN f USING (lang),
           (SELECT unnest(range(-10, 11)) AS i)),
    l AS (SELECT lang, t, avg(ln(exp(z[1] / t) + exp(z[2] / t)) - z[y + 1] / t) AS nll
          FROM r GROUP BY lang, t)
    SELECT lang, {sql_round("arg_min(t, nll)", 6)} AS temperature, {sql_round("min(nll)", 6)} AS nll
    FROM l GROUP BY lang""",
)
def refined_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = studies.fit_temperature(
        _calibration(spark, sf_dir), "logits", "label", ["lang"], _TEMPERATURES
    )
    return best.withColumns({c: round_to(F.col(c), 6) for c in ("temperature", "nll")})


# A second stand-in, blind to words: pieces of four characters of the unspaced text.
_BLIND_PIECES = Tokenizer(
    split=lambda text: F.regexp_extract_all(
        F.regexp_replace(text, f"{JAVA_WS}+", ""), F.lit("(?s).{1,4}"), F.lit(0)
    ),
    join=lambda tokens: F.array_join(tokens, ""),
)


@register(
    CATALOG,
    f"""WITH w AS (
      SELECT doc_id, lang, regexp_extract_all(text, '{NWS}+') AS words FROM documents),
    p AS (SELECT doc_id, lang, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
    e AS (SELECT doc_id, lang, i,
                 sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS edge,
                 sum(length(word)) OVER (PARTITION BY doc_id) AS total FROM p)
    SELECT lang, count(*) AS n_word_ends,
           count(*) FILTER (WHERE edge % 4 = 0 OR edge = total) AS n_shared_ends,
           {sql_round("count(*) FILTER (WHERE edge % 4 = 0 OR edge = total)::DOUBLE / count(*)::DOUBLE", 6)}
             AS boundary_agreement
    FROM e GROUP BY lang""",
)
def boundary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = studies.boundary_agreement(docs, "text", ["lang"], _BLIND_PIECES)
    return found.withColumn("boundary_agreement", round_to(F.col("boundary_agreement"), 6))


@register(
    CATALOG,
    f"""WITH t AS (SELECT regexp_extract_all(text, '{NWS}+')[1:256] AS tokens, quality
              FROM documents JOIN labels USING (doc_id))
    SELECT array_to_string([('0x' || md5(x)[1:8])::BIGINT % 65536 FOR x IN tokens], ' ') AS ids,
           len(tokens)::BIGINT AS n_attended, quality AS labels
    FROM t""",
)
def tokenized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = tokenized(docs.join(labels, "doc_id").withColumnRenamed("quality", "label"))
    return rows.select(
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_attended"),
        "labels",
    )
