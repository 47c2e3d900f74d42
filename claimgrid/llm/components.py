"""Connected components by alternating large and small stars; every round is written to the shared folder.

Links that lead to a least node are what a component ends as, so that node of a large component has very many edges (a hub). A
node with over max(`HUB`, edges / `HUB`) edges from above is one of at most `HUB`; the least neighbours of such nodes are broadcast,
so their edges stay where they are, and only the other nodes' edges are dealt by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import stored

HUB = 1000


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """What lies above a node goes to the node's least neighbour, or to the node itself where that is the least."""
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    to = lambda df, m: df.select("u", F.coalesce(m, "v").alias("v"))
    hubs = stored(edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("node"))
    if hubs.isEmpty():
        return to(edges.join(least.withColumnRenamed("node", "v"), "v", "left"), "m").distinct()
    own = hubs.join(least, "node", "left").select(F.col("node").alias("v"), F.col("m").alias("hub_m"), F.lit(True).alias("hub"))
    dealt = edges.join(F.broadcast(own), "v", "left")
    rest = dealt.where("hub is null").select("u", "v").join(least.withColumnRenamed("node", "v"), "v", "left")
    return to(dealt.where("hub"), "hub_m").union(to(rest, "m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """What lies below a node, and the node, go to the least of it."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): each node that is not the least of its component, with that least one. links: (a, b) pairs of nodes, in any
    order, with repetitions. No neighbourhood is gathered: a round only takes minima by node and joins them back. Nodes of a
    dense group share most of their lesser neighbours, so a small star before the first round leaves few edges a node."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges, state = stored(_small_star(edges)), None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state or now[0] == 0:
            return edges
        state = now
        large = stored(_large_star(edges, max(HUB, now[0] // HUB)))       # read twice, so its joins run once
        edges = stored(_small_star(large))
