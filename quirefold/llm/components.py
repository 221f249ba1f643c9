"""Connected components of an edge table, by alternating large and small stars.

Each step is a grouped minimum (combined before the shuffle) and a join back, and its result is written to the shared
folder, so nothing gathers in one task and lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import drop, store


def _star(pairs: DataFrame) -> DataFrame:
    """Of (u, v): each v with the least node that u sees, u itself included; u with it, too."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    to = pairs.join(least, "u")
    return to.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component: the least node that can be reached."""
    now = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    while True:
        # Large star: nodes above u go to the least of u's neighbours.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: u and its smaller neighbours go to the least of them.
        after = store(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v"))), label)
        gone = after.join(now, ["a", "b"], "left_anti").limit(1).count()
        same = not gone and after.count() == now.count()
        drop(now)
        now = after
        if same:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
