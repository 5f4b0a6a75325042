"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: So many edges are settled by one task; more are contracted first, by rounds over all tasks.
TAIL = 50_000


def _hook(rest: DataFrame) -> DataFrame:
    """Every root points at the smallest root next to it, then at that one's target until nothing moves."""
    both = rest.union(rest.select("b", "a"))
    hook = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to"))
    hook = cut(hook.select("root", F.least("root", "to").alias("to")))
    while True:
        up = hook.select(F.col("root").alias("to"), F.col("to").alias("top"))
        nxt = cut(hook.join(up, "to", "left").select(
            "root", F.coalesce("top", "to").alias("to"), (F.coalesce("top", "to") != F.col("to")).alias("moved")))
        hook = nxt.select("root", "to")
        if nxt.where("moved").isEmpty():
            return hook


def _settle(rest: DataFrame) -> DataFrame:
    """``(root, to)`` of a bounded number of edges: the smallest root of each one's component."""
    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        x, y, to = at[:len(pdf)], at[len(pdf):], np.arange(len(names))
        while (to[x] != to[y]).any():
            low = np.minimum(to[x], to[y])
            np.minimum.at(to, to[x], low)
            np.minimum.at(to, to[y], low)
            while (to[to] != to).any():
                to = to[to]
        return pd.DataFrame({"root": names, "to": names[to]})

    kind = rest.schema["a"].dataType.simpleString()
    return rest.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(least, f"root {kind}, to {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tail: int = 0) -> DataFrame:
    """``(node, component)`` with the smallest node of the component as its label.

    Each round contracts the graph at least by half, until one task settles the last ``tail`` edges; only how many are
    left is read back."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    rest = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = rest.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    left, first = rest.count(), True
    while left:
        hook = cut(_settle(rest)) if left <= tail else _hook(rest)
        if first:  # every node is a root
            labels = hook.select(F.col("root").alias("node"), F.col("to").alias("component"))
        else:
            labels = cut(labels.join(hook.withColumnRenamed("root", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")))
        if left <= tail:
            break
        x = hook.select(F.col("root").alias("a"), F.col("to").alias("ra"))
        y = hook.select(F.col("root").alias("b"), F.col("to").alias("rb"))
        moved = rest.join(x, "a").join(y, "b").where("ra <> rb")
        rest = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        left, first = rest.count(), False
    return labels
