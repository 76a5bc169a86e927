"""Connected components of an undirected graph given as edges, by alternating star operations.

Each round points every node's larger neighbours (large star), then its smaller ones (small
star), at the smallest node it sees; rounds are logarithmic in the longest path. Only node
minima are aggregated (with partial aggregation), so a hub with any number of links is never
gathered in one place: what hubs point at is broadcast (a node is a hub from HUB edges on, so
there are fewer hubs than edges / HUB), and only other nodes' edges are shuffled to meet it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somalog.llm.common import cut, remove, write

HUB = 50_000


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """edges (a, b) and least, which the table least (a, least, n) has for a; hub is 0 if there
    are too few edges for a hub."""
    if not hub:
        return edges.join(least.select("a", "least"), "a")
    hubs = F.broadcast(least.where(F.col("n") >= hub).select("a", F.col("least").alias("_hub")))
    marked = edges.join(hubs, "a", "left")
    rest = marked.where("_hub IS NULL").drop("_hub").join(least.where(F.col("n") < hub).select("a", "least"), "a")
    return rest.union(marked.where("_hub IS NOT NULL").select("a", "b", F.col("_hub").alias("least")))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("b > a"), least, hub).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, hub).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(a long, b long) to (node, component): each node that has an edge to another node, and
    the smallest node of its component. Nodes without such an edge are left out."""
    spark = edges.sparkSession
    state, path = write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == last or mark["n"] == 0:
            break
        some = hub if 2 * mark["n"] >= hub else 0
        last, (ahead, next_path) = mark, write(_small_star(_large_star(state, some), some))
        remove(spark, path)
        state, path = ahead, next_path
    found = cut(state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select(F.col("b"), F.col("b"))).distinct())
    remove(spark, path)
    return found
