"""Connected components by contraction: every round replaces nodes by their lowest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _low_ends(lower: DataFrame) -> DataFrame:
    """(node, low): every node at the end of its falling pointers, followed by doubling."""
    while True:
        up = lower.select(F.col("node").alias("_node"), F.col("low").alias("_low"))
        further = materialize(lower.join(up, F.col("low") == F.col("_node")).select("node", F.col("_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")), "lower")
        discard(lower)
        lower = further.drop("moved")
        if further.filter("moved").isEmpty():
            return lower


def linked_roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the lowest node reachable, for every node that has a link to another.

    Each round points a node to the least of itself and its neighbours, follows the pointers
    to their ends by doubling, and contracts the links over that map. Only nodes without a
    lower neighbour are left, so a chain of any length is gone after one round, every round
    works on fewer links than the one before, and none is capped. A hub is met by grouped minima, which combine before they shuffle, and by
    joins against one row per node, whose link side is split where a key is hot; its
    links are never gathered, and once contracted they are gone. Without links there are no rows.
    """
    links = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "links")
    maps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        lower = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("low")), "lower")
        lower = _low_ends(lower)
        maps.append(lower)
        new = (links.join(lower, F.col("a") == F.col("node")).select(F.col("low").alias("_a"), "b")
               .join(lower, F.col("b") == F.col("node")).select("_a", F.col("low").alias("_b"))
               .filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        old, links = links, materialize(new, "links")
        discard(old)
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # compose from the last, smallest map back to the first
    roots = maps[-1]
    for lower in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("_node"), F.col("low").alias("_low"))
        roots = lower.join(later, F.col("low") == F.col("_node"), "left").select("node", F.coalesce("_low", "low").alias("low"))
    found = materialize(roots.select("node", F.col("low").alias("root")), "roots")
    for table in (links, *maps):
        discard(table)
    return found


def components(pairs: DataFrame, nodes: DataFrame, u: str = "u", v: str = "v", node: str = "node_id") -> DataFrame:
    """(node, component): the lowest node id reachable over the pairs; a node without pairs is its own component."""
    roots = linked_roots(pairs, u, v).select(F.col("node").alias("_node"), "root")
    return nodes.select(node).join(roots, F.col(node) == F.col("_node"), "left").select(node, F.coalesce("root", node).alias("component"))
