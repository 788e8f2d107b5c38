"""Connected components of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is one node of its component.

    Each round maps every node to the smallest of its neighbours, taken three
    times over, and the links with it; that keeps components whole and shrinks them
    fast, as node keys are hashes.  Joins read written tables on both sides,
    so that Spark can split the partition of a node with very many links.
    """
    n = links.count()
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().filter("a <> b"), "links", n)
    roots: DataFrame | None = None
    nodes = 2 * n
    while n := edges.count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up")), "hooks", 2 * n)
        for _ in range(2):  # two jumps: the smallest of up to four steps
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = cut(up.join(over.hint("merge"), "up", "left").select("node", F.coalesce("top", "up").alias("up")), "hooks", 2 * n)
        renamed = edges.join(up.select(F.col("node").alias("b"), F.col("up").alias("v")).hint("merge"), "b").select("a", "v")
        renamed = cut(renamed.distinct(), "links", n).join(up.select(F.col("node").alias("a"), F.col("up").alias("u")).hint("merge"), "a").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        edges = cut(renamed.filter("a <> b").distinct(), "links", n)
        if roots is None:
            roots = up.withColumnRenamed("up", "root")
        else:
            step = up.select(F.col("node").alias("root"), F.col("up").alias("top"))
            roots = cut(roots.join(step.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots", nodes)
    if roots is None:
        kind = links.schema["a"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return roots
