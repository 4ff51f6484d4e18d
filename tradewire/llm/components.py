"""Connected components of an edge table by repeated hooking and contraction.

Each round hooks every component to its smallest neighbour, follows the hooks to their ends by
pointer jumping, and relabels the edges, of which only those between components stay. The number
of components with edges at least halves in a round. Edges, labels and components stay in tables;
nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewire.llm.common import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b: long); component is the least node of its component."""
    live = scratch(edges.where("a <> b").select("a", "b").distinct())
    labels = None  # node -> component, for nodes that have been hooked
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        hooks = scratch(hooks)
        while True:  # pointers only lead to smaller nodes, so this ends after a logarithmic number of jumps
            ahead = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = scratch(hooks.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            hooks = step.select("node", "to")
            if step.where("moved").isEmpty():
                break
        new = hooks.select(F.col("node").alias("component"), F.col("to").alias("next"))
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("component"))
        else:
            labels = scratch(labels.join(new, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("na"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        live = scratch(live.join(a, "a").join(b, "b").where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    return labels


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
