"""Connected components by smallest neighbours, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.session import written


def _state() -> tuple[Column, Column]:
    """Two sums that tell tables of labels from each other, whatever the type of their nodes."""
    return F.bit_xor(F.xxhash64("node", "label")), F.sum(F.xxhash64("label", "node").cast("decimal(38,0)"))


def smallest_reachable(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an edge table (a, b); component is the smallest node reachable. Nodes are of any type that can be compared.

    Every round replaces a node's label by the smallest label of its
    neighbours and then by that label's label, which halves long chains. Each
    round's labels are a table of their own, so plans and their size estimates
    stay as they were in the first.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    total = labels.agg(*_state()).first()
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = written(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label")))
        jump = met.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        labels = written(met.join(jump, met["label"] == jump["_node"]).select("node", F.least("label", "_label").alias("label")))
        before, total = total, labels.agg(*_state()).first()
        if total == before:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
