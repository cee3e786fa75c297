"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import cut, shuffled


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 30) -> DataFrame:
    """(node, component) of every node that occurs in ``edges``; the component is its smallest node.

    Each round takes the smallest label among the neighbours and then jumps to that label's own label, so the
    number of rounds grows with the logarithm of the longest chain. Labels are checkpointed every round; the
    driver only sees one count per round. NULL ends are ignored; loops and repeats do no harm.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    sym = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(max_rounds):
        near = (
            sym.join(shuffled(labels.select(F.col("u").alias("v"), "label")), "v")
            .groupBy("u")
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(shuffled(near), "u").select("u", "label", F.least("label", "near").alias("new"))
        hop = labels.select(F.col("u").alias("new"), F.col("label").alias("far"))
        nxt = cut(
            step.join(shuffled(hop), "new", "left").select("u", F.col("label").alias("old"), F.least("new", "far").alias("label"))
        )
        changed = nxt.where("label <> old").limit(1).count()
        labels = nxt.select("u", "label")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
