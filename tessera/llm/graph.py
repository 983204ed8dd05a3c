"""Connected components of links that stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): each linked node and the smallest node it reaches.

    Large-star / small-star contraction: every round hangs each node's larger
    (then smaller) neighbours on its smallest neighbour, with one partial
    minimum a node and one join, until nothing changes. Rounds grow with the
    logarithm of a component's size. Links are (a, b) of one orderable type;
    both directions, repeats and loops are allowed. Links with a null end are
    ignored; no links give an empty table."""
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .where("u is not null and v is not null and u != v").distinct())
    sign = None
    for _ in range(max_rounds):
        # large star: of each node, the larger neighbours go to its smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # small star: the smaller neighbours and the node itself go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        edges = checkpointed(pairs.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
            .where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        sign = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Labels of ``n`` local nodes: the smallest node reached by links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:  # follow labels to their own labels
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    return label
