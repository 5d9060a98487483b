"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is its smallest node.

    Every round each node takes the least label of its neighbours, then its label's label, so the
    labels of a chain double their reach. Rounds end when no label changes. Null ends and loops
    are left out; an empty table gives no nodes.
    """
    # written first: a forest that was computed twice could come out as two, and the graph one-way
    links = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "links")
    both = materialize(links.union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        jumped = taken.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("component"))
        step = materialize(jumped, "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels
