"""Connected components of an edge table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import released, written


def components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` of longs -> ``(node, label)``: label is the smallest node that can be reached.

    Each round takes the smallest label among neighbours (partial aggregation
    before the shuffle) and then the label of the label, so paths shrink by
    doubling. Every table is written to the shared folder: rounds keep no
    lineage, a lost executor costs one round's tasks, and both sides of each
    join are plain exchanges, which adaptive execution can split at a hub node.
    Self-links and repeated rows are allowed; an empty table gives no rows.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = written(both.filter("src <> dst").distinct(), "edges")
    rows = labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["src"] == labels["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        near = written(labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was")), "near")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        old, rows = rows, written(near.join(up, "label").select("node", F.least("label", "up").alias("label"), "was"), "labels")
        labels = rows.select("node", "label")
        released(near, old)
        if rows.filter("label <> was").isEmpty():
            released(both)
            return labels
