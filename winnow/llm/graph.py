"""Connected components by contraction, as joins and grouped minima.

Each round every node points to the smallest id among itself and its neighbours, pointers are
shortened, and the edges are rewritten between the nodes pointed to. A round at least halves the nodes
that still have edges, so the number of rounds grows with the logarithm of the component size. All
tables stay distributed; only "are edges left?" comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.store import forget, saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) -> (node, component): the smallest id reachable. Nodes without edges do not appear."""
    spark = edges.sparkSession
    live = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        parent = saved(both.groupBy("node").agg(F.min("other").alias("p")).select("node", F.least("node", "p").alias("p")), "parent")
        while True:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            shorter = saved(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("q"), F.col("p")), "jump")
            moved = not shorter.where("p <> q").isEmpty()
            old, parent = parent, shorter.select("node", F.col("q").alias("p"))
            forget(old)
            if not moved:
                break
        if mapping is None:
            new = parent.select("node", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), "p")
            new = mapping.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        new = saved(new, "mapping")
        pa = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        pb = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        joined = live.join(pa, "a").join(pb, "b").where("pa <> pb")
        left = saved(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        for old in (live, parent, *([mapping] if mapping is not None else [])):
            forget(old)
        live, mapping = left, new
    return mapping if mapping is not None else spark.createDataFrame([], "node long, component long")
