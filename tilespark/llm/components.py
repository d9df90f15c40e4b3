"""Connected components of a link table, by repeated contraction.

Each round hooks every node to its smallest neighbour, follows the hooks one step
further and relabels the links by where they lead, so each component that is not yet
one node at least halves. Minima are taken with partial aggregation before the
shuffle and repeated links are merged, so a node with very many links costs no task
more than its share; every round ends in tables in the shared folder, and deletes those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import discard, settle


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b. Returns (node, root) for every node of a link.

    Nodes in one component share a root; which of them it is, is not defined. Links
    from a node to itself and repeated links change nothing; no links give no rows.
    """
    links = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        smallest = settle(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("hook")))
        up = smallest.select(F.col("node").alias("hook"), F.col("hook").alias("up"))
        hooks = settle(smallest.join(up, "hook").select("node", F.col("up").alias("hook")))
        known = labels
        if known is None:
            labels = settle(hooks.withColumnRenamed("hook", "root"))
        else:
            labels = settle(known.join(hooks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("hook", "root").alias("root")))
        of_a = hooks.select(F.col("node").alias("a"), F.col("hook").alias("new_a"))
        of_b = hooks.select(F.col("node").alias("b"), F.col("hook").alias("new_b"))
        moved = links.join(of_a, "a").join(of_b, "b").where("new_a <> new_b")
        left = settle(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
        discard(smallest, hooks, known, links)
        links = left
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
