"""Group shares, rank tests, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentiweave.catalog.registry import Query, register, sql_round, sql_strip, table
from sentiweave.functions.numeric import round_to
from sentiweave.operators import metrics
from sentiweave.operators.dedupe import keep_first
from sentiweave.operators.ranktest import mann_whitney, mann_whitney_pairs
from sentiweave.operators.ratios import sentiment_ratios as ratios

CATALOG: dict[str, Query] = {}

_RATIOS = "avg(CASE WHEN sentiment_label = 1 THEN 1.0::DOUBLE WHEN sentiment_label IS NOT NULL THEN 0.0 END)"


@register(
    CATALOG,
    f"""WITH d AS (
      SELECT doc_id, lang, source, text FROM documents
      QUALIFY row_number() OVER (PARTITION BY lower({sql_strip("text")}) ORDER BY doc_id) = 1)
    SELECT lang, source, {sql_round("avg((quality = 1)::INTEGER::DOUBLE)", 6)} AS positive_ratio,
           count(*) AS count
    FROM d LEFT JOIN labels USING (doc_id) GROUP BY lang, source""",
)
def sentiment_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = keep_first(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "text", "doc_id"
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("sentiment_label"))
    shares = ratios(unique.join(labels, "doc_id", "left"), ["lang", "source"])
    return shares.withColumn("positive_ratio", round_to(F.col("positive_ratio"), 6))


@register(
    CATALOG,
    f"""WITH t AS (
      SELECT l_returnflag, l_linestatus, (l_discount > 0.05)::INTEGER AS sentiment_label
      FROM lineitem)
    SELECT l_returnflag, l_linestatus, {sql_round(_RATIOS, 6)} AS positive_ratio, count(*) AS count
    FROM t GROUP BY ALL""",
)
def sentiment_ratios_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        (F.col("l_discount") > 0.05).cast("int").alias("sentiment_label"),
    )
    shares = ratios(rows, ["l_returnflag", "l_linestatus"])
    return shares.withColumn("positive_ratio", round_to(F.col("positive_ratio"), 6))


def _halves(vector: Column) -> Column:
    """Two class logits from a whole vector: its largest and its negated smallest element."""
    return F.array(F.array_max(vector).cast("double"), (-F.array_min(vector)).cast("double"))


_LOGITS_SQL = "[list_max(embedding)::DOUBLE, -(list_min(embedding)::DOUBLE)]"


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as two-class logits, labelled by class group, with the language of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        (F.col("label") >= 5).cast("int").alias("label"),
        metrics.predicted_class(_halves(F.col("embedding"))).alias("guess"),
    )
    return vectors.join(docs, "doc_id")


_GUESSED = f"""guessed AS (
  SELECT lang AS language, (label >= 5)::INTEGER AS label,
         CASE WHEN {_LOGITS_SQL}[2] > {_LOGITS_SQL}[1] THEN 1 ELSE 0 END AS guess
  FROM embeddings JOIN documents ON vec_id = doc_id)"""


def _metrics_sql(key: str) -> str:
    tp, fp, fn = (
        f"count(*) FILTER (WHERE {c})"
        for c in ("label = 1 AND guess = 1", "label <> 1 AND guess = 1", "label = 1 AND guess <> 1")
    )
    lead = f"{key}, " if key else ""
    return f"""SELECT {lead}count(*) AS n_rows,
      {sql_round("count(*) FILTER (WHERE label = guess)::DOUBLE / count(*)::DOUBLE", 6)} AS accuracy,
      {sql_round(f"coalesce(({tp})::DOUBLE / nullif({tp} + {fp}, 0)::DOUBLE, 0)", 6)} AS precision,
      {sql_round(f"coalesce(({tp})::DOUBLE / nullif({tp} + {fn}, 0)::DOUBLE, 0)", 6)} AS recall,
      {sql_round(f"coalesce((2 * {tp})::DOUBLE / nullif(2 * {tp} + {fp} + {fn}, 0)::DOUBLE, 0)", 6)} AS f1
    FROM guessed {"GROUP BY " + key if key else ""}"""


@register(CATALOG, f"WITH {_GUESSED} {_metrics_sql('')}")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.binary_metrics(_guessed(spark, sf_dir), "label", "guess")
    return found.withColumns({m: round_to(F.col(m), 6) for m in metrics.METRICS})


@register(
    CATALOG,
    f"""WITH {_GUESSED}, m AS ({_metrics_sql("language")})
    SELECT 'val_' || language || '_eval_' || k AS metric,
           CASE k WHEN 'accuracy' THEN accuracy WHEN 'precision' THEN precision
                  WHEN 'recall' THEN recall ELSE f1 END AS value
    FROM m, (VALUES ('accuracy'), ('precision'), ('recall'), ('f1')) AS v(k)""",
)
def metrics_per_language_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_language = metrics.binary_metrics(_guessed(spark, sf_dir), "label", "guess", ["language"])
    return metrics.metrics_long(per_language).withColumn("value", round_to(F.col("value"), 6))


def _rank_test_sql(rows: str, keys: str) -> str:
    """U, z and p from ranks: ``rows`` yields keys, value v and in_a.

    The normal law's tail is one minus an integral, taken by Simpson's rule over 2,000 steps.
    """
    weight = "CASE WHEN k % 2000 = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum([({weight}) * exp(-pow(least(z, 12) * k / 2000.0::DOUBLE, 2) / 2) FOR k IN range(2001)])"
    p = f"CASE WHEN z <= 0 THEN 1 ELSE greatest(0, 1 - 2 * {area} * least(z, 12) / 6000 / sqrt(2 * pi())) END"
    return f"""WITH t AS ({rows}),
    r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY v)
                    + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0::DOUBLE AS rk,
                 count(*) OVER (PARTITION BY {keys}, v)::DOUBLE AS ties FROM t),
    s AS (SELECT {keys}, count(*) FILTER (WHERE in_a) AS n_a, count(*) FILTER (WHERE NOT in_a) AS n_b,
                 sum(rk) FILTER (WHERE in_a) AS ra, sum(ties * ties - 1) AS ties FROM r GROUP BY {keys}),
    u AS (SELECT *, ra - n_a * (n_a + 1) / 2.0::DOUBLE AS u, n_a::DOUBLE * n_b AS nn,
                 (n_a + n_b)::DOUBLE AS n FROM s),
    z AS (SELECT *, (greatest(u, nn - u) - nn / 2 - 0.5::DOUBLE)
                    / sqrt(nn / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
    SELECT {keys}, n_a, n_b, ties, u, {sql_round("z", 6)} AS z, abs({sql_round(p, 6)}) AS p_value
    FROM z"""


def _rounded(tests: DataFrame) -> DataFrame:
    return tests.withColumns({c: F.abs(round_to(F.col(c), 6)) if c == "p_value" else round_to(F.col(c), 6) for c in ("z", "p_value")})


_LANG_PAIRS = """SELECT a AS sample_a, b AS sample_b, n_chars::DOUBLE AS v, lang = a AS in_a
      FROM documents JOIN (VALUES ('de', 'en'), ('de', 'es'), ('de', 'fr'), ('en', 'es'),
                                  ('en', 'fr'), ('es', 'fr')) AS p(a, b) ON lang IN (a, b)"""


@register(CATALOG, _rank_test_sql(_LANG_PAIRS, "sample_a, sample_b"))
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tests = mann_whitney_pairs(docs, "n_chars", "lang", ["en", "es", "fr", "de"])
    return _rounded(tests)


@register(
    CATALOG,
    _rank_test_sql(
        """SELECT l_linestatus, l_extendedprice AS v, l_returnflag = 'R' AS in_a
           FROM lineitem WHERE l_returnflag IN ('R', 'N')""",
        "l_linestatus",
    ),
)
def mann_whitney_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N"))
    tests = mann_whitney(
        rows, "l_extendedprice", F.col("l_returnflag") == "R", ["l_linestatus"]
    )
    return _rounded(tests)


@register(
    CATALOG,
    _rank_test_sql(
        """SELECT sample_a, sample_b, value AS v, event_type = sample_a AS in_a
           FROM events JOIN (
             SELECT a.t AS sample_a, b.t AS sample_b
             FROM (SELECT DISTINCT event_type AS t FROM events) a
             JOIN (SELECT DISTINCT event_type AS t FROM events) b ON a.t < b.t)
           ON event_type IN (sample_a, sample_b)""",
        "sample_a, sample_b",
    ),
)
def mann_whitney_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    types = [r[0] for r in events.select("event_type").distinct().collect()]
    tests = mann_whitney_pairs(events, "value", "event_type", types)
    return _rounded(tests)


@register(
    CATALOG,
    f"""WITH r AS (
      SELECT o_custkey AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2 AS in_a,
             rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS rk,
             count(*) OVER (PARTITION BY o_custkey, o_totalprice) AS same
      FROM orders),
    s AS (
      SELECT grp, count(*) AS n, sum(rk) FILTER (WHERE in_a) AS ra FROM r
      GROUP BY grp HAVING count(*) > 2 AND max(same) = 1),
    u AS (SELECT grp, n, ra - 3 AS u, least(ra - 3, 2 * (n - 2) - (ra - 3)) AS low FROM s),
    c AS (
      SELECT grp, count(*) AS ways FROM (
        SELECT grp, low, i, unnest(range(i + 1, n + 1)) AS j
        FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u))
      WHERE i + j - 3 <= low GROUP BY grp)
    SELECT u.grp, 2 AS n_a, n - 2 AS n_b, u.u::DOUBLE AS u,
           {sql_round("least(1.0::DOUBLE, 2 * ways::DOUBLE / (n * (n - 1) / 2)::DOUBLE)", 9)} AS p_value
    FROM u JOIN c ON c.grp = u.grp
    UNION ALL
    SELECT -1, 1, n - 1, (rk - 1)::DOUBLE,
           {sql_round("least(1.0::DOUBLE, 2 * (least(rk - 1, n - rk) + 1)::DOUBLE / n::DOUBLE)", 9)}
    FROM (SELECT (SELECT count(*) FROM orders) AS n,
                 (SELECT count(*) FROM orders WHERE o_orderkey < (SELECT o_orderkey FROM orders
                  ORDER BY o_totalprice, o_orderkey LIMIT 1)) + 1 AS rk)""",
)
def mann_whitney_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p: each customer's first two orders against the others, and the key of the
    cheapest order against all other keys."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    small = mann_whitney(orders.withColumn("_a", nth <= 2), "o_totalprice", F.col("_a"), ["o_custkey"])
    tested = small.where("n_b > 0 and ties = 0").select(F.col("o_custkey").alias("grp"), "n_a", "n_b", "u", "p_value")
    cheapest = orders.agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey"))).first()[0]
    one = mann_whitney(orders, "o_orderkey", F.col("o_orderkey") == F.lit(cheapest))
    alone = one.select(F.lit(-1).alias("grp"), "n_a", "n_b", "u", "p_value")
    return tested.unionByName(alone).withColumn("p_value", round_to(F.col("p_value"), 9))
