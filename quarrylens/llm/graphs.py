"""Connected components of pairs, by least labels and pointer jumping, with checkpoints between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import cut


def components(edges: DataFrame, node_type: str = "long") -> DataFrame:
    """(a, b) links to (node, root): the least node that can be reached, for each node with a link.

    A round: each node takes the least label next to it, then the label of its label. Rounds grow with the logarithm of the
    longest chain in practice; all sums are of at most a row a task. An edge lives on only between different labels.
    """
    # cut before both directions are taken: made twice, links that depend on the order of rows could differ
    edges = cut(edges.select(F.least("a", "b").cast(node_type).alias("a"), F.greatest("a", "b").cast(node_type).alias("b")).filter("a <> b").distinct())
    both = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        moved = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = moved.select(F.col("node").alias("up"), F.col("root").alias("above"))
        moved = cut(moved.join(up, moved.root == up.up).select("node", "old", F.least("root", "above").alias("root")))
        labels = moved.select("node", "root")
        if moved.filter("old <> root").isEmpty():
            return labels
