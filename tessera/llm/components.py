"""Connected components of an edge table, by least labels next door and label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``node``, ``component`` (the least node of its component) for every node in ``edges``.

    Each round a node takes the least label among its own and its neighbours', then that label's own label, so labels
    reach twice as far each round: rounds grow with the logarithm of the longest path. One checkpoint and one count a
    round; only the count reaches the driver. Neighbours' labels are joined by node and reduced before the shuffle, so a
    node with very many edges costs its edges, not their square. An empty table gives an empty result; edges with a
    null end are left out. With ``rounds``, only so many rounds: equal labels then still mean one component, but one
    component may have several labels (a star has one after one round).
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = shared(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = shared(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"), F.lit(True).alias("moved")))
    while rounds != 0 and not labels.filter("moved").isEmpty():
        rounds = None if rounds is None else rounds - 1
        next_door = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("m"))
        reached = labels.drop("moved").join(next_door, labels.node == next_door.u).select("node", F.col("component").alias("old"), F.least("component", "m").alias("now"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        labels = shared(reached.join(jump, reached.now == jump["_n"]).select("node", F.least("now", "_c").alias("component"), (F.least("now", "_c") < F.col("old")).alias("moved")))
    return labels.drop("moved")
