"""Connected components of an edge table by alternating large-star and small-star steps.

Each step links nodes to the smallest node around them; the number of rounds grows with the logarithm of the longest
path. Edges never leave the executors. The smallest node around each is a pre-aggregated minimum. Edges of nodes with a
large share of all edges, such as the centre of a large star, get it from a broadcast of these nodes, of which there are
few by that share; the others in an equi-join, where no key then has many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialize

#: A node with more than one in MOST_HOT of all edge ends (and with FEW or more) is hot; there are at most MOST_HOT.
MOST_HOT = 1000
FEW = 100


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows (a, b) with m of their a; least: a, m, n (rows of a)."""
    cut = max(2 * n_edges // MOST_HOT, FEW)
    hot, cold = least.where(F.col("n") > cut).drop("n"), least.where(F.col("n") <= cut).drop("n")
    few = rows.join(F.broadcast(hot.select("a")), "a", "left_anti").join(cold, "a")
    return few.unionByName(rows.join(F.broadcast(hot), "a"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both, least, n_edges).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _with_least(down, least, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of the component), for each node of an edge (a, b) with a <> b."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = (edges.count(), None)
    for _ in range(most_rounds):
        old = WRITTEN[-1]
        edges = materialize(_small_star(_large_star(edges, state[0]), state[0]).where("a <> b").distinct(), "edges")
        discard(edges.sparkSession, old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
