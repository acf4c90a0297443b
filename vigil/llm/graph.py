"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of the links (a, b): label is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label's own label.  Every round is
    written to the shared folder; the rounds end when no label changes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("new"))
        far = step.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        step = step.join(far, "new").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("label")).alias("moved"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if not step.filter("moved").limit(1).count():
            return labels
