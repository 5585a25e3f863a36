"""Connected components of an undirected graph, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import stash, unstash
from siltstone.llm._filters import release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node that it is connected with.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until all edges lead to roots: the number of rounds
    grows with the logarithm of the number of nodes in practice, and a hub's edges are spread by the joins. Each round is
    written to the shared folder. Only a count reaches the driver, and after each round it lets go of what it holds of it.
    """
    now = stash(_clean(edges.select("a", "b")), "edges")
    while not _stars(now):
        new = stash(_small(_large(now)), "edges")
        unstash(now)
        now = new
        release(edges.sparkSession)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _clean(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, once."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node with an edge to a smaller one has another edge; neither step would change an edge then."""
    up, down = (F.struct(F.col(c).alias("node"), F.lit(n).alias("up")) for c, n in (("a", 1), ("b", 0)))
    nodes = edges.select(F.inline(F.array(up, down))).groupBy("node").agg(F.max("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return not nodes.where("up = 1 and n > 1").limit(1).count()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    # Edges lead to smaller nodes, so a node without one of its own is the least itself.
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    return _clean(edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _clean(tied.unionByName(least.select("a", F.col("m").alias("b"))))


def colored(rows: DataFrame, colors: DataFrame | None, node: str = "x") -> DataFrame:
    """Rows with ``color``: the least node that theirs is connected with so far; colors: (node, root)."""
    if colors is None:
        return rows.withColumn("color", F.col(node))
    return rows.join(colors.select(F.col("node").alias(node), "root"), node, "left").withColumn("color", F.coalesce("root", node)).drop("root")


def merged(colors: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after new links (a, b): these connect roots, so each round's graph has only what the rounds before left apart."""
    if colors is None:
        return stash(components(links), "colors")
    both = colored(links.select(F.col("a").alias("x"), "b"), colors).select(F.col("color").alias("a"), F.col("b").alias("x"))
    edges = stash(colored(both, colors).select("a", F.col("color").alias("b")).where("a <> b").distinct(), "edges")
    if not edges.limit(1).count():
        return colors
    roots = components(edges)
    moved = colors.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    old = moved.select("node", F.coalesce("to", "root").alias("root"))
    fresh = roots.join(colors.select("node"), "node", "left_anti")
    out = stash(old.unionByName(fresh), "colors")
    for x in (colors, edges):
        unstash(x)
    return out
