"""Connected components of a link table, by joins only; and of the links that one task found."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import joinable, saved


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """One row (node, component) for each node that has a link; component is the smallest node reachable.

    Each round, every node picks the neighbour (or itself) whose hash under that
    round's seed is smallest, and all nodes that picked the same one melt into it. Links
    within a melted node go, and so a constant share of the nodes goes each round: the
    rounds grow with the logarithm of the longest path, also where numbers ascend along
    it. Nothing but the count of remaining links and what is small enough to broadcast reaches the driver. Links with a null
    end and links of a node to itself are ignored; repeated links do no harm. ``rows``: the
    most links there may be, if known.
    """
    left = saved(
        links.select(
            F.least(F.col(a).cast("long"), F.col(b).cast("long")).alias("u"),
            F.greatest(F.col(a).cast("long"), F.col(b).cast("long")).alias("v"),
        )
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "links",
        rows,
    )
    n = left.count()
    nodes = 2 * n  # at most
    ends = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    mapping = ends.select("node", F.col("node").alias("root"))
    seed = 0
    while n:
        seed += 1
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        pick = (
            both.groupBy("u")
            .agg(F.min(F.struct(rank("v").alias("h"), F.col("v").alias("v"))).alias("best"))
            .select("u", F.when(F.col("best.h") < rank("u"), F.col("best.v")).otherwise(F.col("u")).alias("to"))
        )
        pick = joinable(saved(pick, "picks", 2 * n), 2 * n)
        mapping = saved(
            mapping.join(pick.withColumnRenamed("u", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "roots",
            nodes,
        )
        left = saved(
            left.join(pick.select("u", F.col("to").alias("x")), "u")
            .join(pick.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
            .where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
            .distinct(),
            "links",
            n,
        )
        n = left.count()
    smallest = mapping.groupBy("root").agg(F.min("node").alias("component"))
    return mapping.join(joinable(smallest, nodes), "root").select("node", "component")


def spanning_links(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same components as all of (u, v): each node with its component's smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]
