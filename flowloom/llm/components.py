"""Connected components by contraction: every round points each node at its
smallest neighbour, follows the pointers, and keeps the links between the
groups so made. Groups are aggregates with map-side combine, never lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.runtime import write_table


def _follow(parent: DataFrame) -> DataFrame:
    """Each pointer replaced by the pointer of what it points at."""
    up = parent.select(F.col("node").alias("p"), F.col("root").alias("top"))
    return parent.join(up, parent.root == up.p, "left").select("node", F.coalesce("top", "root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, root): the smallest node that each
    linked node reaches. Nodes without a link to another node are left out;
    an empty table gives an empty table."""
    links = write_table(links.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
    found = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("root"))
        parent = write_table(_follow(_follow(parent)), "parents")
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("node").alias("p"), F.col("root").alias("top"))
            found = write_table(found.join(up, found.root == up.p, "left").select(
                "node", F.coalesce("top", "root").alias("root")), "roots")
        for end in ("a", "b"):
            up = parent.select(F.col("node").alias("p"), F.col("root").alias("top"))
            links = links.join(up, links[end] == up.p).drop(end, "p").withColumnRenamed("top", end)
        links = write_table(links.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
