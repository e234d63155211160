"""Connected components of a link table, by contraction.

Every node hooks to its smallest neighbour; chains of hooks are shortened by joining the table with itself; links are
carried over to what their ends hook to, and loops vanish. A node that is smallest in its component never moves, so what
remains at the end is each component's smallest node. The number of nodes with links at least halves each round. Only
aggregations and joins on one key are used (a hub's rows are pre-aggregated, or split by skew-join handling), each
round's tables are checkpointed, and nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (of one type). Returns node, component: for each node that has a link to another, the smallest node reachable."""
    links = durable(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label: DataFrame | None = None
    while not links.isEmpty():
        ends = links.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("to")))
        hook = durable(ends.groupBy("node").agg(F.min("to").alias("to")))
        while True:
            far = hook.select(F.col("node").alias("to"), F.col("to").alias("top"))
            jumped = durable(hook.join(far, "to").select("node", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
            hook = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = hook
        else:  # nodes of earlier rounds follow; every node of a later round is a root of an earlier one
            step = hook.select(F.col("node").alias("to"), F.col("to").alias("top"))
            label = durable(label.join(step, "to", "left").select("node", F.coalesce("top", "to").alias("to")))
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where(F.col("ra") != F.col("rb"))
        links = durable(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.select("node", F.col("to").alias("component"))
