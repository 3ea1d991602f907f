"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds. A round is two aggregations
(the smallest neighbour of every node, combined before the shuffle) and two
equi-joins that adaptive execution can split, so a hub with a third of all
edges is no single task's work. The edge table is checkpointed once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import checkpointed


def _smallest(directed: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and u's neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
    return directed.join(least, directed["u"] == least["_u"]).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Return (node, component), component being the smallest node reachable.

    ``edges`` has columns a, b (comparable, not null). Self-loops and repeated
    edges are harmless. Only nodes with an edge to another node are returned.
    Raises if ``max_rounds`` are not enough; about log2 of the longest path
    are.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _smallest(large)
        joined = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpointed(joined.select("e.u", "e.v").filter("u <> v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == before:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = seen
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
