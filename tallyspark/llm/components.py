"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.base import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b: longs): root is the component's smallest node.

    Each round hangs a node's larger neighbours on its smallest neighbour (large star), then its smaller ones on the
    smallest of them (small star), until nothing changes; the number of rounds grows with the logarithm of the nodes. A
    hub's neighbours are met by an aggregate and a join on the node, never gathered in one group. Links of a node with itself
    or with null and repeated links are dropped. An empty table gives an empty result.
    """
    marked = lambda x: tuple(x.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
    links = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = marked(links)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # each link has its larger end in a: what hangs on u = b moves to the smallest of u and its neighbours
        smallest = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        smallest = materialize(smallest.select(F.col("a").alias("b"), F.least("m", "a").alias("m")))
        large = materialize(links.join(smallest, "b").select("a", F.col("m").alias("b")).distinct())
        # u = a and its smaller neighbours hang on the smallest of these
        smallest = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        below = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(below.union(smallest.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, marked(links)
        if mark == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
