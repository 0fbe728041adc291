"""Connected components: of some links in numpy, of a link table in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the smallest one it reaches: no more links than nodes, the same components."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _smallest(pairs: DataFrame) -> DataFrame:
    """node, low: the smallest of a node and its partners in (node, other).

    Stored, so that the join it goes into has nothing but its two exchanges below it and a frequent node can be split.
    """
    return stored(pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("low")), "smallest")


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of links (a, b), the smallest node that it reaches. Nodes without links don't occur.

    Alternating large-star and small-star steps: each replaces links by links to a smaller node and keeps what is
    connected. A node with very many links is never gathered: its smallest partner comes from a partial aggregate
    and goes back by a join, which Spark splits where a key is frequent. Every round is written to the shared folder.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    state = None
    while True:
        both = now.select(F.col("v").alias("node"), F.col("u").alias("other")).unionByName(now.select(F.col("u").alias("node"), F.col("v").alias("other")))
        large = stored(both.join(_smallest(both), "node").where("other > node").select(F.col("other").alias("v"), F.col("low").alias("u")).where("v <> u").distinct(), "links")
        down = large.select(F.col("v").alias("node"), F.col("u").alias("other"))
        low = _smallest(down)
        small = down.join(low, "node").select(F.col("other").alias("v"), F.col("low").alias("u")).unionByName(low.select(F.col("node").alias("v"), F.col("low").alias("u"))).where("v <> u").distinct()
        now = stored(small, "links")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
