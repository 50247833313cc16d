"""Connected components by hooking and shortcutting over parent tables.

Input is an edge table of two BIGINT node columns.  Each round every node
hooks onto its smallest neighbour when that is smaller, chains are shortcut by
pointer jumping, and the edges are rewritten to roots, so loops and repeated
edges vanish and the graph at least halves.  All state lives in tables in
shared storage; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.storage import materialize


def _shortcut(parent: DataFrame) -> DataFrame:
    """Point every node of ``parent(node, up)`` at the root of its tree."""
    while True:
        jumped = parent.alias("a").join(parent.alias("b"), F.col("a.up") == F.col("b.node"), "left").select(
            F.col("a.node").alias("node"), F.col("a.up").alias("was"), F.coalesce("b.up", "a.up").alias("up")
        )
        jumped = materialize(jumped, "parents")
        moved = not jumped.filter("up <> was").isEmpty()
        parent = jumped.select("node", "up")
        if not moved:
            return parent


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Smallest node of each node's component.

    Returns ``(node BIGINT, root BIGINT)``, one row for each node that occurs
    in ``edges``.  Edges with a null end are ignored; loops make their node
    known; repeated edges and edges in both directions count once.  An empty
    edge table gives an empty result.
    """
    pairs = edges.select(F.col(left).cast("bigint").alias("u"), F.col(right).cast("bigint").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = pairs.selectExpr("u AS node").union(pairs.selectExpr("v AS node")).distinct().withColumn("root", F.col("node"))
    open_edges = pairs.filter("u <> v")
    while not open_edges.isEmpty():
        # hook: the smallest neighbour below a node becomes its parent
        hooks = open_edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("up"))
        parent = _shortcut(materialize(hooks, "hooks"))
        labels = labels.alias("l").join(parent.alias("p"), F.col("l.root") == F.col("p.node"), "left").select("l.node", F.coalesce("p.up", "l.root").alias("root"))
        labels = materialize(labels, "labels")
        e = open_edges.alias("e").join(parent.alias("p"), F.col("e.u") == F.col("p.node"), "left").select(F.coalesce("p.up", "e.u").alias("u"), F.col("e.v").alias("v"))
        e = e.alias("e").join(parent.alias("p"), F.col("e.v") == F.col("p.node"), "left").select(F.col("e.u").alias("u"), F.coalesce("p.up", "e.v").alias("v"))
        open_edges = materialize(e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return labels
