"""Connected components of an edge table, by hooking to smaller neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.store import materialize


def _follow(pointers: DataFrame, by: DataFrame) -> DataFrame:
    """node, root with every root replaced by where `by` points it, and whether that moved it."""
    up = by.select(F.col("node").alias("root"), F.col("root").alias("above"))
    met = pointers.select("node", "root").join(up, "root", "left")
    return met.select("node", F.coalesce("above", "root").alias("root"), F.coalesce(F.col("above") < F.col("root"), F.lit(False)).alias("moved"))


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (of one orderable type) -> node, root for every node that has an edge to another; root is the component's smallest node.

    Each round points every node to its smallest neighbour where that is smaller, follows pointers until all end at a node that
    points nowhere (their distance halves with every step), and contracts the edges to these ends.  An end is smaller than all its
    neighbours, so at most half of the nodes stay: rounds and steps are logarithmic in the input, whatever the order of ids.
    Every step is written to the shared folder, so that no lineage builds up.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = materialize(both, "edges")
    labels = None
    while labels is None or _any(both):
        tree = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "hooks")
        while True:
            once = _follow(tree, tree)
            tree = materialize(_follow(once, once), "steps")
            if not _any(tree.filter("moved")):
                break
        labels = tree.select("node", "root") if labels is None else materialize(_follow(labels, tree).select("node", "root"), "labels")
        a = tree.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = tree.select(F.col("node").alias("v"), F.col("root").alias("b"))
        both = both.join(a, "u").join(b, "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        both = materialize(both, "edges")
    return labels
