"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Edges that one task steps through. Smaller graphs take one task, where no step has to shuffle.
EDGES_PER_TASK = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """u (b, the larger end) and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, scratch: Scratch, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) for each node with an edge; the component is its least node.

    ``edges`` has long columns a and b. Each step is written to the shared folder and counted as it is
    written; steps follow until the graph does not change, when each node hangs from its least one.
    """

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, tuple[int, object]]:
        seen = Observation()
        now = scratch.keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), name)
        return now, (seen.get["n"], seen.get["sum"])

    now, state = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "edges")
    before = None
    while state[0] and state != before:
        after, next_state = kept(_small_star(_large_star(now.coalesce(-(-state[0] // edges_per_task)))), "stars")
        scratch.drop(now)
        now, before, state = after, state, next_state
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
