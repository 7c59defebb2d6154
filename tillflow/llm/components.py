"""Connected components of a large graph by label propagation in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable, for every node of ``links(a, b)``.

    Alternates two linear steps until nothing moves: every node hangs its
    larger neighbours below its smallest one (large star), then its smaller
    neighbours below the smallest (small star). The number of links never
    grows, a star's centre only combines minima, and the number of rounds grows
    with the logarithm of a component's size. Each round is written to the
    shared folder, so a lost executor costs at most a round. The driver sees
    two numbers a round.
    """
    def larger_below(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return (both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct())

    def smaller_below(e: DataFrame) -> DataFrame:
        # a < b in every link: b's smaller neighbours are all its a
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        joined = e.join(low, "b")
        hung = joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return hung.unionByName(low.select(F.col("m").alias("a"), "b")).distinct()

    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where("a < b").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        # a forest of stars stays as it is under both steps
        if (state.n, state.h) == seen or state.n == 0:
            break
        seen = (state.n, state.h)
        edges = written(smaller_below(larger_below(edges)), "links")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
