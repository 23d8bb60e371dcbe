"""Removal of lines that spread over many distinct sites (boilerplate).

One HyperLogLog sketch of sites for each line hash, built inside of each task and merged by
the shuffle's aggregation. A sketch only estimates: lines whose estimate lies near the
threshold get an exact distinct count, all others are decided by the sketch alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, hash_pair, table

#: A line on so many distinct sites or more is boilerplate.
MIN_SITES = 5
#: log2 of a sketch's buckets: a relative standard error of 1.6 %.
SKETCH_BITS = 12
#: Estimates within this factor of the threshold are counted exactly: 15 standard errors.
NEAR = 1.25


def line_text(line: Column) -> Column:
    """What of a line is compared: the line without spaces, tabs and CR at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def document_lines(docs: DataFrame, site: str) -> DataFrame:
    """line (hash pair), site and doc_id of every line that isn't blank."""
    lines = F.explode(F.split(F.col("text"), "\n", -1))
    return (
        docs.select("doc_id", F.coalesce(F.col(site), F.lit("")).alias("site"), lines.alias("line"))
        .select("doc_id", "site", line_text(F.col("line")).alias("line"))
        .where("line <> ''")
        .select("doc_id", "site", hash_pair(F.col("line")).alias("line"))
    )


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """line and keeper: the hash pair of each boilerplate line and the smallest doc_id with it.

    A null site counts as a site of its own. Only lines near the threshold are counted
    exactly, with one row for each line and site after the task's own aggregation.
    """
    lines = document_lines(docs, site)
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"),
        F.min("doc_id").alias("keeper"),
    )
    seen = cut_lineage(spread.where(F.col("sites") >= min_sites / NEAR))
    sure = seen.where(F.col("sites") > min_sites * NEAR).select("line", "keeper")
    near = seen.where(F.col("sites") <= min_sites * NEAR).select("line", "keeper")
    # Pairs are made distinct before the join: no task gets all rows of a frequent line.
    exact = (
        lines.select("line", "site")
        .distinct()
        .join(near, "line")
        .groupBy("line")
        .agg(F.count("*").alias("sites"), F.min("keeper").alias("keeper"))
        .where(F.col("sites") >= min_sites)
        .select("line", "keeper")
    )
    return sure.unionByName(exact)


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", removed: str | None = None
) -> DataFrame:
    """``docs`` with every boilerplate line cut out of ``text``, but for one document each.

    docs: doc_id, text and the site column; all columns are kept, ``n_chars``, if there,
    follows the new text. The document with the smallest doc_id keeps the line (where no
    row with the line has a doc_id, none does), so that what a group of copies says isn't
    lost. Blank lines stay. A null text stays null. ``removed`` names an added column with
    the number of lines cut. Rows that repeat a doc_id are cut alike.
    """
    boilerplate = boilerplate_lines(docs, min_sites, site)
    lines = document_lines(docs, site).select("doc_id", "line")
    cuts = (
        lines.join(boilerplate, "line")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("cut_id"))
        .agg(F.collect_set("line").alias("cut"))
    )
    # Other columns travel as one struct, so that none can clash with those used here.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select(F.struct(*(others or [F.lit(0)])).alias("row"), "doc_id", "text")
    joined = packed.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    split = F.split(F.col("text"), "\n", -1)
    kept = F.filter(
        split,
        lambda x: (line_text(x) == "") | ~F.array_contains(F.col("cut"), hash_pair(line_text(x))),
    )
    untouched = F.col("cut").isNull()
    out = joined.select(
        "row",
        "doc_id",
        F.when(untouched, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(untouched, F.lit(0)).otherwise(F.size(split) - F.size(kept)).cast("long").alias("removed"),
    )
    own = ("doc_id", "text")
    columns = {c: F.col(c) if c in own else F.col("row")[c] for c in docs.columns}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("removed") > 0, F.length("text").cast(kind)).otherwise(columns["n_chars"])
    if removed:
        columns[removed] = F.col("removed")
    return out.select(*(column.alias(name) for name, column in columns.items()))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_removed lines, n_chars left and the remaining text's md5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cut = without_boilerplate(docs, removed="n_removed")
    return cut.select(
        "doc_id",
        "n_removed",
        F.length("text").cast("long").alias("n_chars_left"),
        F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
    )


OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, idx, raw,
         regexp_replace(raw, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
               generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)
), spread AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), marked AS (
  SELECT l.*, s.keeper IS NOT NULL AND s.keeper <> l.doc_id AS cut
  FROM lines l LEFT JOIN spread s ON l.line = s.line
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY idx) FILTER (WHERE NOT cut), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_removed, length(text) AS n_chars_left, md5(text) AS text_md5 FROM kept
"""
