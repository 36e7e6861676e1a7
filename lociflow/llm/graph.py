"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, disk: Scratch, name: str) -> DataFrame:
    """(node, root) of every node in edges (a, b), where root is the smallest node of its component.

    Each round gives every node the smallest root among its neighbours' and then
    that root's own root, so paths shorten by half; it ends when no root
    changes. Roots and edges stay in tables; a round sends the driver one count.
    """
    both = disk.write(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), f"{name}-edges")
    roots = disk.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        low = roots.join(near, roots["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        over = roots.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = disk.write(low.join(over, "low", "left").select("node", "root", F.coalesce("up", "low").alias("next")), f"{name}-{step}")
        changed = new.where(F.col("root") != F.col("next")).limit(1).count()
        roots = new.select("node", F.col("next").alias("root"))
        if step > 1:
            disk.drop(f"{name}-{step - 1}")
        if not changed:
            return roots
