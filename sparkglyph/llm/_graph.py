"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import drop_path, work_path, written


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label) for every node of `links` (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among neighbours and then the label of that label, so that chains halve; each
    round's labels are a table in the shared folder. Ends when no label changes."""
    spark = links.sparkSession
    both = written(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a")), "links")
    path = work_path(spark, "labels")
    labels = written(both.groupBy(F.col("v").alias("node")).agg(F.least("node", F.min("u")).alias("label")), "", path)
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        next_path = work_path(spark, "labels")
        moved = written(own.join(hop, "via").select("node", F.least("via", "far").alias("label"), "old"), "", next_path)
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        drop_path(spark, path)
        path = next_path
        if not changed:
            return labels
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
