"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release


#: Edges up to which the smallest neighbours are broadcast; beyond it they meet the edges by a shuffle.
BROADCAST_EDGES = 500_000


def components(edges: DataFrame, name: str = "components", hubs: int = 10_000) -> DataFrame:
    """node and component (its smallest node) for every node of the edges u, v (longs).

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour, until every node
    hangs on one other that hangs on none. The smallest neighbours come from map-side aggregates, once for each half of
    a round. Up to BROADCAST_EDGES edges they are broadcast, and what hangs on a node is hung on that node's smallest
    neighbour in turn, twice, which saves rounds. Beyond it, a node with more edges than one in `hubs` of all meets them by
    a broadcast (of fewer than 2 * hubs rows) instead of gathering them in one task.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        n = now.count()
        least = materialize(_few(_neighbours(now), n), name)
        if least.filter("open").isEmpty():
            release(least)
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _met(both.filter("v > u"), least, n, hubs).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if n <= BROADCAST_EDGES:
            onward = F.broadcast(least.select(F.col("u").alias("v"), "m"))
            for _ in range(2):
                large = large.join(onward, "v").select("u", F.col("m").alias("v"))
        large = materialize(large.filter("u <> v"), name)
        smaller = materialize(_few(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), n), name)
        hung = _met(large, smaller, n, hubs)
        after = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, now = now, materialize(_few(after, n), name)
        release(before, least, large, smaller)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _neighbours(edges: DataFrame) -> DataFrame:
    """Of each node u: m, the smallest of itself and its neighbours; n, its edges; open, whether it hangs on several, or on one while others hang on it."""
    ends = edges.select("u", F.col("v").alias("m"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("m"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    found = ends.groupBy("u").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return found.select("u", F.least("u", "m").alias("m"), "n", F.expr("hangs > 1 or (hangs = 1 and holds = 1)").alias("open"))


def _few(df: DataFrame, edges: int) -> DataFrame:
    """df in few partitions where there are few edges: else a round over a small graph is mostly empty tasks and small files."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism + edges // 10_000) if edges <= BROADCAST_EDGES else df


def _met(edges: DataFrame, least: DataFrame, n: int, hubs: int) -> DataFrame:
    """edges with their node u's m in `least`; beyond BROADCAST_EDGES, of n in all, those of nodes with many edges by a broadcast."""
    if n <= BROADCAST_EDGES:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    most = max(100, n // hubs)
    many = F.broadcast(least.filter(F.col("n") > most).select("u", F.col("m").alias("hub")))
    marked = edges.join(many, "u", "left")
    few = marked.filter("hub is null").drop("hub").join(least.filter(F.col("n") <= most).select("u", "m"), "u")
    return few.unionByName(marked.filter("hub is not null").select("u", "v", F.col("hub").alias("m")))
