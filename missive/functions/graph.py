"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.sources.tables import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b: long) the smallest node it is connected with, as a written table.

    In a round every node offers the smallest label around it to itself and to the node that
    its own label names, and labels are then replaced by their label's label, so distances
    halve. Rounds end when no label has changed; nothing but their number reaches the driver.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    changed = not labels.isEmpty()
    while changed:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        offers = labels.join(around, "node").select(F.inline(F.array(F.struct("node", F.col("low").alias("offer")), F.struct(F.col("component").alias("node"), F.col("low").alias("offer")))))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = labels.join(best, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("offer", "component")).alias("component"))
        above = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = written(hooked.join(above, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        changed = not new.filter("component <> was").isEmpty()
        removed(labels)
        labels = new
    removed(both)
    return labels
