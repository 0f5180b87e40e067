"""Connected components of an edge table, without moving it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.runtime import discard, materialise


#: Links of a node that is joined by broadcast.
HUB = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) is connected to.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each one
    grouped aggregation and a join by node; the number of rounds grows with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.union(now.select("b", "a"))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        # a node of very many links is joined by broadcast: there are at most 2 / HUB such nodes a link
        hubs = least.where(F.col("n") > HUB).select("a", "m")
        light = both.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") <= HUB).select("a", "m"), "a")
        joined = light.unionByName(both.join(F.broadcast(hubs), "a"))
        large = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialise(small, "links")
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now, least)
        now = new
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
