"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns node, label for every node of an edge; label is the component's smallest node.

    Labels take the least label around them, then the label of their label, until none changes; each round is written, so
    a lost executor costs one round at most. Edges of a node with very many meet its label in a join that Spark can split.
    """
    both = written(edges.select("a", "b").where("a != b").unionByName(edges.selectExpr("b as a", "a as b").where("a != b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("label", "least").alias("new"), F.col("label").alias("old"))
        target = nearer.select(F.col("node").alias("n"), F.col("new").alias("jump"))
        new = written(nearer.join(target, F.col("new") == F.col("n"), "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label != old").isEmpty():
            return labels
