"""Connected components of a graph given as a table of edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.sources.shared import written


def _jumped(parents: DataFrame) -> DataFrame:
    """Follows parents to the roots: each round a node's parent becomes its parent's parent."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        joined = parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved"))
        told = written(joined, "parents")
        parents = told.select("node", "parent")
        if told.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root) for every node of an edge; roots are one node of each component.

    Each round every node takes its smallest neighbour, if smaller than itself, as parent, the stars are
    contracted and the edges between them go on; at least half of the nodes that still have edges vanish a
    round. Minima combine before the shuffle, so a node with very many edges is no burden to one task. Edges
    may repeat, in either direction; those with a null end and loops are left out; no edges give no rows.
    """
    edges = written(edges.select("a", "b").where("a <> b"), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).select("node", F.least("node", "parent").alias("parent"))
        parents = _jumped(written(parents, "parents"))
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            on = parents.select(F.col("node").alias("root"), F.col("parent"))
            roots = written(roots.join(on, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        for side in ("a", "b"):
            edges = edges.join(parents.select(F.col("node").alias(side), F.col("parent").alias(f"to_{side}")), side).drop(side).withColumnRenamed(f"to_{side}", side)
        edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
