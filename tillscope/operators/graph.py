"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.session import cut, release, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a, b); the component is its smallest node.

    Alternates the large-star and small-star steps, which keep the number of edges and flatten every component to a
    star in a logarithmic number of rounds. A node of very many edges is a key of partial aggregates only in its
    minimum; its edges are never gathered in one row. Self-loops and repeated edges do no harm; an empty input gives
    an empty result. Each round is written to the shared folder, and only one count and one sum come to the driver.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null").distinct())
    loops = e.where("a = b")
    e, last, before = e.where("a < b"), None, None
    for _ in range(max_rounds):
        # Large star: every neighbour larger than a node goes to the node's smallest neighbour (or itself).
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        # Small star: every smaller neighbour of a node, and the node, go to its smallest neighbour.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select("m", F.explode(F.array("a", "b")).alias("x")).where("m <> x")
        e, path = stored(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct())
        if before:
            release(before)
        before = path
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not complete after {max_rounds} rounds")
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component")).join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(roots).unionByName(alone).distinct()
