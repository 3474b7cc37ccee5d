"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a minimum over the edges of a node, whose rows go to disk where they are many; a round deals
the edges out three times and writes them to the shared folder once. Rounds grow with the
logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from intake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root) for every node with a link; root is its component's least node.

    Loops, repeated edges and either direction are fine; an empty table gives an empty one.
    """
    edges, before = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), None
    while True:
        edges, state = edges
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = state
        both = _with_least(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"))
        large = _with_least(both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        edges = _written(large.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b"))


def _with_least(rows: DataFrame) -> DataFrame:
    """Rows (a, b) with the least b of their a as m."""
    return rows.withColumn("m", F.min("b").over(Window.partitionBy("a")))


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The distinct edges, written, and by what they are known: their number and a sum of hashes, taken while they are written."""
    seen = Observation()
    written = cut(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
    return written, seen.get
