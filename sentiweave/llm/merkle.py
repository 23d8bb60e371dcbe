"""Merkle manifest of a dataset: a tree for each group, their roots under one root, proofs.

A leaf is the digest of a row. Leaves are numbered in the order of their group, and every
ARITY consecutive nodes have the digest of their concatenated digests (hex text) as parent,
until one node is left. Only every STEP-th level is stored: a subtree of ARITY ** STEP
aligned nodes is one group of rows, from which the levels between are computed, used and
dropped again. Building keeps each subtree's top; proof extraction regenerates the levels
between from the stored nodes, emits each node's siblings, and appends the path of the
subtree's top, which it has got from the subtree above.

Groups of any size are numbered by ranges, so none is in one task; a subtree has at most
ARITY ** STEP rows of a digest each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written
from .ordering import with_positions

ARITY = 8
#: Levels from one stored level to the next.
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_of(fields: list[Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else its length in UTF-8 bytes, a colon, its value."""
    texts = [field.cast("string") for field in fields]
    return digest(
        F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))
    )


def _above(size: Column) -> Column:
    """Nodes on the level above one of ``size`` nodes."""
    return F.when(size > 1, F.ceil(size / ARITY)).otherwise(size).cast("long")


def _parents(nodes: Column, size: Column) -> Column:
    """The level above ``nodes``, aligned nodes of a level that has ``size`` in all; a single one stays."""

    def made(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1)
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), "")))

    return F.when(size > 1, let(nodes, made)).otherwise(nodes)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """A row for each aligned subtree of stored nodes (group, position, size, digest, any others).

    ``members`` are its rows in order, ``level0`` to ``level<STEP>`` the digests of its levels
    and ``size0`` to ``size<STEP>`` the nodes that these levels have in the whole tree.
    """
    others = [c for c in nodes.columns if c not in ("group", "position", "size", "digest")]
    member = F.struct("position", "digest", *others)
    found = (
        nodes.where("size > 1")
        .groupBy("group", F.expr(f"position div {ARITY**STEP}").alias("subtree"), F.col("size").alias("size0"))
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .withColumn("level0", F.transform("members", lambda m: m["digest"]))
    )
    for k in range(STEP):
        found = found.withColumn(f"level{k + 1}", _parents(F.col(f"level{k}"), F.col(f"size{k}"))).withColumn(
            f"size{k + 1}", _above(F.col(f"size{k}"))
        )
    return found


def _climb(nodes: DataFrame) -> DataFrame:
    """The next stored level of the trees that have more than one node in this one."""
    return _subtrees(nodes).select(
        "group",
        F.col("subtree").alias("position"),
        F.col(f"size{STEP}").alias("size"),
        F.element_at(f"level{STEP}", 1).alias("digest"),
    )


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """Every STEP-th level of all trees; leaves: stored, with group, position, size and digest."""
    levels = [leaves]
    while not levels[-1].where("size > 1").limit(1).isEmpty():
        levels.append(written(_climb(levels[-1])))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """group and digest of the one node that is left of each tree."""
    found = [nodes.where("size = 1").select("group", "digest") for nodes in levels]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def _steps(place: Column) -> Column:
    """The steps of a subtree's member from its level up to the subtree's top, lowest first.

    A step is the node's place in its run of siblings and the others of the run in order.
    """
    steps = []
    for k in range(STEP):
        here = F.expr(f"cast({ARITY**k} as int)")
        at = F.floor(place / here).cast("int")
        run = F.slice(F.col(f"level{k}"), F.floor(at / ARITY).cast("int") * ARITY + 1, F.lit(ARITY))
        inside = (at % ARITY).cast("int")
        others = F.concat(F.slice(run, F.lit(1), inside), F.slice(run, inside + 2, F.lit(ARITY)))
        step = F.struct(inside.alias("place"), others.alias("siblings"))
        steps.append(F.when(F.col(f"size{k}") > 1, step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def paths(levels: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The leaves' rows with ``path``: array of (place, siblings) from the leaf to the outermost root.

    outer: group, ``above`` (path of the tree's root in what holds the trees), and any columns
    that all rows of a tree are to get.
    """
    given = [c for c in outer.columns if c not in ("group", "above")]
    found = None
    for nodes in reversed(levels):
        others = [c for c in nodes.columns if c not in ("group", "position", "size")]
        tops = nodes.where("size = 1").join(outer, "group").select(
            "group", "position", *others, *given, F.col("above").alias("path")
        )
        if found is None:
            found = tops
            continue
        above = found.select("group", F.col("position").alias("subtree"), F.col("path").alias("above"), *given)

        def member(m: Column, i: Column, others: list[str] = others) -> Column:
            path = F.concat(_steps(i), F.col("above"))
            return F.struct(m["position"].alias("position"), *(m[c].alias(c) for c in others), path.alias("path"))

        inner = _subtrees(nodes).join(above, ["group", "subtree"]).select(
            "group", F.explode(F.transform("members", lambda m, i: member(m, i))).alias("m"), *given
        )
        found = inner.select("group", "m.position", *(f"m.{c}" for c in others), *given, "m.path").unionByName(tops)
    return found


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the groups' trees, and of the tree over their roots."""

    levels: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> str | None:
        """None for a table without rows."""
        found = roots(self.top).first()
        return found and found["digest"]

    def proofs(self) -> DataFrame:
        """Rows given to :func:`manifest` with digest, subroot, root and path (see :func:`paths`)."""
        one = roots(self.top).select("group", F.col("digest").alias("root")).withColumn("above", _no_steps())
        outer = paths(self.top, one).select(
            F.col("name").alias("group"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root"
        )
        return paths(self.levels, outer)


def _no_steps() -> Column:
    return F.array().cast("array<struct<place:int,siblings:array<string>>>")


def group_key(value: Column) -> Column:
    """A text without nulls that sorts as ``value`` does, nulls first."""
    return F.coalesce(F.concat(F.lit("+"), value.cast("string")), F.lit(""))


def manifest(leaves: DataFrame, order: str) -> Manifest:
    """leaves: group (see :func:`group_key`), digest, the ``order`` column (nulls first, equal ones
    by digest) and any others, which proofs return."""
    numbered = written(with_positions(written(leaves), "group", [order, "digest"]))
    levels = stored_levels(numbered)
    subroots = written(roots(levels).select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"))
    return Manifest(levels, stored_levels(written(with_positions(subroots, "group", ["name"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""

    def up(node: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], F.lit(1), step["place"])
        after = F.slice(step["siblings"], step["place"] + 1, F.lit(ARITY))
        return digest(F.concat(F.array_join(before, ""), node, F.array_join(after, "")))

    return F.aggregate(path, leaf, up)


def tampered_text() -> Column:
    """The text, with A-Z in lower case where 3 divides the crc32 of doc_id as text."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """Proof digests of all rows, and whether rows that were tampered with are found out.

    Null doc_ids come first in their tree, rows that repeat one are ordered by their leaves.
    """
    fields = {name: F.col(name) for name in FIELDS}
    leaves = docs.select(
        group_key(F.col("lang")).alias("group"),
        "doc_id",
        leaf_of(list(fields.values())).alias("digest"),
        leaf_of(list((fields | {"text": tampered_text()}).values())).alias("presented"),
    )
    found = manifest(leaves, "doc_id").proofs()
    siblings = F.flatten(F.transform("path", lambda step: step["siblings"]))
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        digest(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.col("presented"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_proofs(table(spark, sf_dir, "documents"))
