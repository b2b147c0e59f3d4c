"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the edges (a, b): the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so the rounds grow with the logarithm of a component's diameter.  Every round's labels are
    written to the shared folder; the driver sees one count.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = shared.written(both.distinct(), "links")
    labels = shared.written(links.groupBy("a").agg(F.min("b").alias("m"))
                            .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (links.join(labels, F.col("b") == F.col("node")).groupBy("a")
                .agg(F.min("component").alias("m")))
        least = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        after = least.join(jump, F.col("new") == F.col("via"), "left").select(
            "node", "old", F.least("new", F.coalesce("far", "new")).alias("component"))
        after = shared.written(after, "labels")
        labels = after.select("node", "component")
        if not after.filter("old <> component").limit(1).count():
            return labels
