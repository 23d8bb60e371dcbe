"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for every node of ``links`` (a, b).

    Both columns have one orderable type; nulls and loops are left out. Alternates two
    steps until every node points at its root: neighbours below a node are tied to the
    smallest of them, then a node's parent is replaced by the parent's smallest parent.
    Each step has at most as many links as before, and only the side that holds one row a
    node is joined to hot roots, so that adaptive execution can split those. Rounds grow
    with the logarithm of the longest chain; each is written to the shared folder.
    """
    current = cut_lineage(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
        .distinct()
    )
    signature = None
    while True:
        smallest = current.groupBy("child").agg(F.min("parent").alias("low"))
        tied = (
            current.join(smallest, "child")
            .select(F.explode(F.array("child", "parent")).alias("child"), F.col("low").alias("parent"))
            .where("child <> parent")
            .distinct()
        )
        above = tied.groupBy("child").agg(F.min("parent").alias("low")).withColumnRenamed("child", "parent")
        current = cut_lineage(
            tied.join(above, "parent", "left")
            .select("child", F.coalesce("low", "parent").alias("parent"))
            .distinct()
        )
        found = current.agg(
            F.count("*"),
            F.expr("bit_xor(xxhash64(child, parent))"),
            F.expr("sum(cast(xxhash64(parent, child) as decimal(20)))"),
        ).first()
        if found == signature:
            roots = current.select(F.col("parent").alias("node"), F.col("parent").alias("root"))
            return current.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
                roots.distinct()
            )
        signature = found
