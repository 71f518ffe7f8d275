"""Connected components of a graph in DataFrames.

Each round every node hooks to its smallest neighbour, pointers are followed to their roots by doubling, and the
edges are drawn between roots; a round at least halves the components that are not yet whole. Minima
are taken by partial aggregation and the joins are on single keys, so Spark can split a node with very many
neighbours. All tables go through the shared folder, and those of a round are deleted after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, materialize


def _follow(parents: DataFrame) -> DataFrame:
    """node, root from node, parent (parent <= node): double the pointers until they stand still."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        step = materialize(parents.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("next"), "parent"))
        discard(parents)
        moved = not step.filter(F.col("next") != F.col("parent")).isEmpty()
        parents = step.select("node", F.col("next").alias("parent"))
        if not moved:
            return parents.withColumnRenamed("parent", "root")


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node with an edge (a, b); the label is the smallest node of its component."""
    todo = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not todo.isEmpty():
        both = todo.unionByName(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent"))
        roots = _follow(materialize(hooks))
        if labels is None:
            labels = materialize(roots.select("node", F.col("root").alias("label")))
        else:
            up, before = roots.select(F.col("node").alias("label"), "root"), labels
            labels = materialize(labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
            discard(before)
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        drawn = todo.join(ra, "a").join(rb, "b").filter("ra <> rb")
        left = materialize(drawn.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        discard(todo)
        discard(roots)
        todo = left
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
