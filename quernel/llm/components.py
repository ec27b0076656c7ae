"""Connected components of a graph of any size, by joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut_small, meet


def connected_components(edges: DataFrame, bound: int, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node. Raises if ``most_rounds`` don't suffice. There are ``bound`` edges at most.

    Alternating large and small stars (Kiveris et al. 2014): each round hangs a
    node's neighbours on the least of them. Rounds grow with the logarithm of the
    longest path. Rows of a node meet only sums of them, salted where they are many,
    so a node may have any number of neighbours. Null ends and loops are left out.
    """
    edges = cut_small(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b"), bound)
    n, state = edges.count(), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = meet(both, least, ["a"], 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # written: it is read for its sums and for its rows
        down = cut_small(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), 2 * n)
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = meet(down, least, ["a"], 2 * n)
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        edges = cut_small(small.where("a != b").distinct(), n, let_go=True)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = new[0]
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components are not done after {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
