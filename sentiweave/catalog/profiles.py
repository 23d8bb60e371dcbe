"""Profiling: feature frames, balance, lengths, summaries, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiweave.catalog.registry import (
    NWS,
    Query,
    quality_corpus,
    register,
    sql_normalize,
    sql_round,
    sql_strip,
    sql_words,
    table,
    toxic_corpus,
)
from sentiweave.functions.numeric import round_to
from sentiweave.operators import histogram, profile
from sentiweave.plans.report import primary_length
from sentiweave.plans.summaries import GrowingSummary
from sentiweave.session import scratch_path
from sentiweave.sources.corpora import training_rows
from sentiweave.sources.registry import (
    CorpusSpec,
    registry_frame,
    split_slice,
    take_slice,
    with_row_cap,
)

CATALOG: dict[str, Query] = {}


def _corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stacked corpora: 0/1 labels, word labels, and no labels."""
    language = F.col("lang")
    return profile.stack_corpora(
        {
            "quality": profile.eda_frame(quality_corpus(spark, sf_dir), "text", "quality", language),
            "toxic": profile.eda_frame(toxic_corpus(spark, sf_dir), "text", "sentiment", language),
            "benchmark": profile.eda_frame(
                table(spark, sf_dir, "benchmark").withColumn("label", F.lit(None).cast("int")),
                "text",
                "label",
                "en",
            ),
        }
    )


def _eda_sql(text: str, label: str) -> str:
    return f"""{text} AS text, coalesce({label}::VARCHAR, 'None') AS label,
      length({text})::BIGINT AS char_len, {sql_words(text)}::BIGINT AS word_len"""


_CORPORA = f"""corpora AS (
  SELECT 'quality' AS corpus, lang AS language, {_eda_sql("text", "quality")}
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'toxic', lang, {_eda_sql("text", "CASE toxic WHEN 1 THEN 'negative' ELSE 'positive' END")}
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'benchmark', 'en', {_eda_sql("text", "NULL")} FROM benchmark)"""


def _wide(df: DataFrame, *columns: str) -> DataFrame:
    """Integer columns as bigint, so that both engines print the same type."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@register(
    CATALOG,
    f"""SELECT {_eda_sql("coalesce(text, '')", "quality")}, lang AS language
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def eda_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return _wide(
        profile.eda_frame(joined, "text", "quality", F.col("lang")), "char_len", "word_len"
    )


@register(CATALOG, f"WITH {_CORPORA} SELECT * FROM corpora")
def stacked_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(_corpora(spark, sf_dir), "char_len", "word_len")


@register(
    CATALOG,
    f"""WITH {_CORPORA}, c AS (
      SELECT corpus, label, count(*) AS count FROM corpora GROUP BY ALL),
    t AS (SELECT corpus, sum(count) AS total FROM c GROUP BY corpus)
    SELECT corpus, label, count,
           {sql_round("count::DOUBLE / total::DOUBLE", 4)} AS ratio,
           {sql_round("count::DOUBLE / total::DOUBLE * 100", 1)} AS pct
    FROM c JOIN t USING (corpus)""",
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_distribution(_corpora(spark, sf_dir), "label", ["corpus"])


def _floor_quantile_sql(value: str, q: float, index: str = "i", n: str = "n") -> str:
    return f"(max({value}) FILTER (WHERE {index} = floor({q}::DOUBLE * ({n} - 1))))::DOUBLE"


@register(
    CATALOG,
    f"""WITH t AS (SELECT lang, length(text) AS c, {sql_words("text")} AS w FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c) - 1 AS ci,
                 row_number() OVER (PARTITION BY lang ORDER BY w) - 1 AS wi,
                 count(*) OVER (PARTITION BY lang) AS n FROM t)
    SELECT lang, {_floor_quantile_sql("c", 0.5, "ci")} AS char_p50,
           {_floor_quantile_sql("c", 0.9, "ci")} AS char_p90,
           {_floor_quantile_sql("c", 0.95, "ci")} AS char_p95,
           {_floor_quantile_sql("w", 0.5, "wi")} AS word_p50,
           {_floor_quantile_sql("w", 0.9, "wi")} AS word_p90,
           {_floor_quantile_sql("w", 0.95, "wi")} AS word_p95
    FROM r GROUP BY lang""",
)
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = profile.eda_frame(docs, "text", "source", F.col("lang"))
    # Both lengths go through one histogram: one scan, one set of running counts.
    long = lengths.select(
        F.col("language").alias("lang"),
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_len").alias("length"))
                    for kind in ("char", "word")
                )
            )
        ),
    )
    wanted = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    per_kind = histogram.quantiles(long, ["lang", "kind"], "length", wanted)
    return per_kind.groupBy("lang").agg(
        *(
            F.max(F.when(F.col("kind") == kind, F.col(p))).alias(f"{kind}_{p}")
            for kind in ("char", "word")
            for p in wanted
        )
    )


_SUMMARY = f"""{_CORPORA},
r AS (
  SELECT *, lower({sql_strip("text")}) AS k, NOT regexp_matches(text, '{NWS}') AS blank,
         row_number() OVER (PARTITION BY corpus, language ORDER BY char_len) - 1 AS ci,
         row_number() OVER (PARTITION BY corpus, language ORDER BY word_len) - 1 AS wi,
         count(*) OVER (PARTITION BY corpus, language) AS n
  FROM corpora),
l AS (
  SELECT corpus, language, label, count(*) AS c FROM corpora GROUP BY ALL),
lc AS (
  SELECT corpus, language,
         '{{' || string_agg('''' || label || ''': ' || c, ', ' ORDER BY label) || '}}' AS label_counts
  FROM l GROUP BY ALL),
p AS (
  SELECT corpus, language,
    CASE WHEN bool_and(label IN ('0', '1'))
         THEN {sql_round("sum(CASE WHEN label = '1' THEN c ELSE 0 END)::DOUBLE / sum(c)::DOUBLE", 4)}
         WHEN bool_and(lower(label) IN ('negative', 'positive'))
         THEN {sql_round("sum(CASE WHEN lower(label) = 'positive' THEN c ELSE 0 END)::DOUBLE / sum(c)::DOUBLE", 4)}
    END AS positive_ratio
  FROM l GROUP BY ALL),
s AS (
  SELECT corpus, language, count(*) AS n_rows, count(DISTINCT label) AS n_unique_labels,
    {sql_round("sum(char_len)::DOUBLE / count(*)::DOUBLE", 1)} AS char_len_mean,
    {_floor_quantile_sql("char_len", 0.5, "ci")} AS char_len_p50,
    {_floor_quantile_sql("char_len", 0.9, "ci")} AS char_len_p90,
    {_floor_quantile_sql("char_len", 0.95, "ci")} AS char_len_p95,
    max(char_len) AS char_len_max,
    {sql_round("sum(word_len)::DOUBLE / count(*)::DOUBLE", 1)} AS word_len_mean,
    {_floor_quantile_sql("word_len", 0.5, "wi")} AS word_len_p50,
    {_floor_quantile_sql("word_len", 0.9, "wi")} AS word_len_p90,
    {_floor_quantile_sql("word_len", 0.95, "wi")} AS word_len_p95,
    {sql_round("count(*) FILTER (WHERE char_len > 256)::DOUBLE / count(*)::DOUBLE * 100", 2)}
      AS pct_over_char_threshold,
    count(*) FILTER (WHERE blank) AS empty_texts,
    {sql_round('''(count(*) FILTER (WHERE NOT blank) - count(DISTINCT k) FILTER (WHERE NOT blank))::DOUBLE
      / count(*) FILTER (WHERE NOT blank)::DOUBLE''', 4)} AS duplicate_rate
  FROM r GROUP BY ALL),
summary AS (
  SELECT s.*, label_counts, positive_ratio,
         {sql_round("abs(positive_ratio - 0.5)", 4)} AS label_skew,
         CASE WHEN language = 'zh' THEN 'char_len' ELSE 'word_len' END AS primary_length_metric,
         CASE WHEN language = 'zh' THEN char_len_p95 ELSE word_len_p95 END AS primary_len_p95,
         n_unique_labels = 2 AS is_binary
  FROM s JOIN lc USING (corpus, language) JOIN p USING (corpus, language))"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summarize_corpora(_corpora(spark, sf_dir), ["corpus", "language"])


@register(CATALOG, f"WITH {_SUMMARY} SELECT * FROM summary")
def growing_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all corpora from the counts of three parts, one of them counted twice."""
    stacked = _corpora(spark, sf_dir)
    part = F.pmod(F.xxhash64("text", "label"), F.lit(3))
    growing = GrowingSummary(spark, scratch_path(spark, "summary"), ["corpus", "language"])
    for number in (0, 1, 2, 1):
        growing.add(f"part{number}", stacked.where(part == number))
    summary = growing.summary()
    return summary.withColumn("label_counts", profile.label_counts_text(F.col("label_counts")))


@register(CATALOG, f"WITH {_SUMMARY} SELECT * FROM summary")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _summary(spark, sf_dir)
    return summary.withColumn("label_counts", profile.label_counts_text(F.col("label_counts")))


@register(
    CATALOG,
    f"""WITH {_SUMMARY}
    SELECT corpus AS name, CASE corpus WHEN 'quality' THEN 'train' ELSE 'validation' END AS role,
           language, 'local/' || corpus AS dataset_id, n_rows, is_binary, positive_ratio,
           label_skew, char_len_p95, word_len_p95,
           pct_over_char_threshold AS pct_over_char_256, duplicate_rate, empty_texts, label_counts
    FROM summary WHERE language <> 'de'
    UNION ALL SELECT corpus, NULL, language, NULL, n_rows, is_binary, positive_ratio, label_skew,
           char_len_p95, word_len_p95, pct_over_char_threshold, duplicate_rate, empty_texts, label_counts
    FROM summary WHERE language = 'de'""",
)
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = tuple(
        CorpusSpec(name, name, role, language, "text", "label", dataset_id=f"local/{name}")
        for name, role in (
            ("quality", "train"),
            ("toxic", "validation"),
            ("benchmark", "validation"),
        )
        # The registry doesn't know the German parts: they stay, without its fields.
        for language in ("en", "es", "fr", "zh")
    )
    return profile.summary_rows(_summary(spark, sf_dir), registry_frame(spark, specs))


@register(
    CATALOG,
    f"""WITH {_SUMMARY}
    SELECT corpus, language, 'not_binary' AS rule, n_unique_labels::DOUBLE AS measured
    FROM summary WHERE NOT is_binary
    UNION ALL SELECT corpus, language, 'label_skew', label_skew FROM summary WHERE label_skew > 0.1
    UNION ALL SELECT corpus, language, 'duplicates', duplicate_rate
    FROM summary WHERE duplicate_rate > 0.05
    UNION ALL SELECT corpus, language, 'empty_texts', empty_texts::DOUBLE
    FROM summary WHERE empty_texts > 0
    UNION ALL SELECT corpus, language, 'long_texts', pct_over_char_threshold
    FROM summary WHERE pct_over_char_threshold > 5
    UNION ALL SELECT corpus, language, 'labels_need_mapping', n_unique_labels::DOUBLE
    FROM summary JOIN (SELECT corpus, language FROM l GROUP BY ALL
                       HAVING NOT bool_and(label IN ('0', '1'))) USING (corpus, language)""",
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _summary(spark, sf_dir).withColumn("name", F.struct("corpus", "language"))
    return profile.quality_flags(named).select("name.corpus", "name.language", "rule", "measured")


@register(
    CATALOG,
    f"""WITH t AS (
      SELECT 'integer' AS encoding, lang AS grp, quality::VARCHAR AS l, quality::DOUBLE AS v
      FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'boolean', lang, toxic::VARCHAR, toxic::DOUBLE
      FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'zero_four', lang, NULL, quality * 4
      FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'words', lang, CASE toxic WHEN 1 THEN 'Negative' ELSE 'positive' END, NULL
      FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'short_words', lang, CASE toxic WHEN 1 THEN 'neg' ELSE 'POS' END, NULL
      FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'mixed', lang,
                       CASE WHEN toxic = 1 THEN 'neg' ELSE 'positive' END, NULL
      FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'many', 'all', NULL, label FROM embeddings),
    c AS (SELECT encoding, grp, l, v, count(*) AS n FROM t GROUP BY ALL)
    SELECT encoding, grp, CASE
      WHEN bool_and(v IN (0, 1)) THEN {sql_round("coalesce(sum(n) FILTER (WHERE v = 1), 0)::DOUBLE / sum(n)::DOUBLE", 4)}
      WHEN count(v) = 2 THEN {sql_round("arg_max(n, v)::DOUBLE / sum(n)::DOUBLE", 4)}
      WHEN bool_and(lower(l) IN ('negative', 'positive'))
      THEN {sql_round("coalesce(sum(n) FILTER (WHERE lower(l) = 'positive'), 0)::DOUBLE / sum(n)::DOUBLE", 4)}
      WHEN bool_and(lower(l) IN ('neg', 'pos'))
      THEN {sql_round("coalesce(sum(n) FILTER (WHERE lower(l) = 'pos'), 0)::DOUBLE / sum(n)::DOUBLE", 4)}
      END AS positive_ratio
    FROM c GROUP BY ALL""",
)
def positive_ratio_by_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    bad = F.col("toxic") == 1
    encodings = {
        "integer": F.col("quality"),
        "boolean": bad,
        "zero_four": F.col("quality") * 4,
        "words": F.when(bad, "Negative").otherwise("positive"),
        "short_words": F.when(bad, "neg").otherwise("POS"),
        "mixed": F.when(bad, "neg").otherwise("positive"),
    }
    parts = [
        profile.positive_ratio(
            labelled.select(F.col("lang").alias("grp"), label.alias("label")), "label", ["grp"]
        ).select(F.lit(name).alias("encoding"), "*")
        for name, label in encodings.items()
    ]
    many = profile.positive_ratio(table(spark, sf_dir, "embeddings"), "label").select(
        F.lit("many").alias("encoding"), F.lit("all").alias("grp"), "positive_ratio"
    )
    return reduce(DataFrame.unionByName, [*parts, many])


@register(
    CATALOG,
    f"""WITH t AS (
      SELECT lang, quality, coalesce(length(text), 0) AS c, coalesce({sql_words("text")}, 0) AS w,
             NOT coalesce(regexp_matches(text, '{NWS}'), false) AS blank
      FROM documents JOIN labels USING (doc_id)),
    l AS (SELECT lang, quality, count(*) AS n FROM t GROUP BY ALL),
    lc AS (SELECT lang, '{{' || string_agg(quality || ': ' || n, ', ' ORDER BY quality) || '}}'
             AS label_counts, count(*) AS n_unique_labels FROM l GROUP BY lang)
    SELECT lang, count(*) AS n_rows, 'doc_id, text, lang, source, n_chars, quality' AS columns,
           any_value(label_counts) AS label_counts, any_value(n_unique_labels) AS n_unique_labels,
           min(c) AS char_len_min, max(c) AS char_len_max,
           {sql_round("sum(c)::DOUBLE / count(*)::DOUBLE", 1)} AS char_len_mean,
           {sql_round("sum(w)::DOUBLE / count(*)::DOUBLE", 1)} AS word_len_mean,
           count(*) FILTER (WHERE blank) AS empty_texts
    FROM t JOIN lc USING (lang) GROUP BY lang""",
)
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.corpus_profile(quality_corpus(spark, sf_dir), "text", "quality", ["lang"])
    text = profile.label_counts_text(F.col("label_counts"), quote=False)
    return _wide(found.withColumn("label_counts", text), "char_len_min", "char_len_max")


def _token_stats_sql(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""WITH t AS (SELECT {lead}{sql_words("text")} AS k FROM {source}),
    r AS (SELECT *, row_number() OVER ({part} ORDER BY k) - 1 AS i, count(*) OVER ({part}) AS n
          FROM t)
    SELECT {lead}count(*) AS token_sample_size,
           {sql_round("sum(k)::DOUBLE / count(*)::DOUBLE", 1)} AS token_len_mean,
           {_floor_quantile_sql("k", 0.5)} AS token_len_p50,
           {_floor_quantile_sql("k", 0.95)} AS token_len_p95,
           max(k)::BIGINT AS token_len_max,
           {sql_round("count(*) FILTER (WHERE k > 256)::DOUBLE / count(*)::DOUBLE * 100", 2)}
             AS pct_over_max_tokens
    FROM r {"GROUP BY " + keys if keys else ""}"""


@register(CATALOG, _token_stats_sql("(SELECT * FROM documents ORDER BY doc_id LIMIT 500)", ""))
def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _wide(profile.token_length_stats(docs, "text", "doc_id", max_samples=500), "token_len_max")


@register(CATALOG, _token_stats_sql("documents", "lang"))
def token_length_stats_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = profile.token_length_stats(docs, "text", "doc_id", max_samples=None, by=["lang"])
    return _wide(stats, "token_len_max")


@register(
    CATALOG,
    f"""WITH {_CORPORA},
    t AS (SELECT corpus, word_len AS v FROM corpora),
    b AS (SELECT corpus, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM t GROUP BY corpus),
    g AS (SELECT corpus, CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo END AS low,
                 CASE WHEN lo = hi THEN hi + 0.5::DOUBLE ELSE hi END AS high FROM b),
    h AS (SELECT corpus, low, high, least(floor((v - low) / (high - low) * 30), 29)::BIGINT AS bin,
                 count(*) AS count FROM t JOIN g USING (corpus) GROUP BY ALL)
    SELECT corpus, bin, {sql_round("low + (high - low) * bin / 30", 6)} AS bin_start,
           {sql_round("low + (high - low) * (bin + 1) / 30", 6)} AS bin_end, count
    FROM h""",
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpora = _corpora(spark, sf_dir).withColumn("primary_len", primary_length())
    bins = histogram.length_histogram(corpora, ["corpus"], "primary_len")
    return bins.withColumns(
        {c: round_to(F.col(c), 6) for c in ("bin_start", "bin_end")}
    ).withColumn("bin", F.col("bin").cast("long"))


@register(
    CATALOG,
    f"""WITH {_CORPORA},
    t AS (SELECT corpus, 'char_len' AS metric, char_len AS v FROM corpora
          UNION ALL SELECT corpus, 'word_len', word_len FROM corpora),
    q AS (SELECT corpus, metric, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                 quantile_cont(v, 0.75) AS q3 FROM t GROUP BY ALL),
    i AS (SELECT *, v BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE AS inside
          FROM t JOIN q USING (corpus, metric))
    SELECT corpus, metric, {sql_round("any_value(q1)", 4)} AS q1,
           {sql_round("any_value(median)", 4)} AS median, {sql_round("any_value(q3)", 4)} AS q3,
           min(v) FILTER (WHERE inside) AS whisker_low, max(v) FILTER (WHERE inside) AS whisker_high,
           count(*) FILTER (WHERE NOT inside) AS n_outliers
    FROM i GROUP BY corpus, metric""",
)
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.array(
        *(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("char_len", "word_len"))
    )
    long = _corpora(spark, sf_dir).select("corpus", F.inline(lengths))
    boxes = histogram.boxplot_stats(long, ["corpus", "metric"], "v")
    rounded = boxes.withColumns({c: round_to(F.col(c), 4) for c in ("q1", "median", "q3")})
    return _wide(rounded, "whisker_low", "whisker_high")


_SPECS = tuple(
    CorpusSpec(
        name, name, role, "en", "text", label, rows=rows, dataset_id=f"local/{name}", load_note=note
    )
    for name, role, label, rows, note in (
        ("quality", "train", "label", 150, ""),
        ("toxic", "validation", "label", None, "Words as labels."),
    )
)
_REGISTRY_SQL = """SELECT n AS name, n AS folder, r AS role, 'en' AS language, 'text' AS text_column,
       'label' AS label_column, 'train' AS split, 'parquet' AS format, 'row_id' AS id_column,
       c::BIGINT AS rows, 'local/' || n AS dataset_id, {note} AS load_note, size
    FROM (VALUES ('quality', 'train', 150, ''), ('toxic', 'validation', NULL, 'Words as labels.')) AS v(n, r, c, t)
    JOIN (SELECT 'quality' AS n, count(quality) AS size FROM labels
          UNION ALL SELECT 'toxic', count(toxic) FROM labels) USING (n)"""


def _sized_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with the rows that each corpus has labels for."""
    labels = table(spark, sf_dir, "labels").agg(F.count("quality"), F.count("toxic"))
    sizes = labels.select(F.explode(F.create_map(F.lit("quality"), "count(quality)", F.lit("toxic"), "count(toxic)")).alias("name", "size"))
    return registry_frame(spark, _SPECS).join(sizes, "name")


@register(CATALOG, _REGISTRY_SQL.format(note="t"))
def registry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized_registry(spark, sf_dir)


@register(
    CATALOG,
    _REGISTRY_SQL.format(note="CASE WHEN t = '' THEN '' ELSE t || ' ' END || 'Inspection cap: 2,000 rows.'"),
)
def row_cap_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_cap(_sized_registry(spark, sf_dir), 2_000)


@register(
    CATALOG,
    f"""SELECT doc_id, {sql_normalize("text")} AS text, quality AS label, 'en' AS language
    FROM (SELECT * FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 150)
    WHERE length({sql_normalize("text")}) > 0 AND quality IN (0, 1)""",
)
def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice that the registry names, harmonized."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").withColumnRenamed("quality", "label")
    head = take_slice(rows, split_slice(_SPECS[0]), "doc_id")
    return training_rows(head, "text", "label", "en", keep=["doc_id"])


@register(
    CATALOG,
    f"""SELECT lang AS name, count(*) AS n_rows, count(DISTINCT quality) AS n_unique_labels,
           min(length(text)) AS char_len_min, max(length(text)) AS char_len_max,
           {sql_round("avg(length(text)::DOUBLE)", 1)} AS char_len_mean,
           count(*) FILTER (WHERE NOT regexp_matches(text, '{NWS}')) AS empty_texts
    FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def profiles_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    profiles = {
        lang: profile.corpus_profile(rows.where(F.col("lang") == lang), "text", "quality")
        for lang in ("de", "en", "es", "fr")
    }
    kept = ("name", "n_rows", "n_unique_labels", "char_len_min", "char_len_max", "char_len_mean", "empty_texts")
    return profile.profiles_frame(profiles).select(*kept)
