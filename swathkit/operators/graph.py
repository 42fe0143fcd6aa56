"""Connectivity of edge tables.

Labels move by rounds of joins and minima with a table written between rounds; the number of rounds grows with
the logarithm of the longest path because labels also jump to the label of their label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.sources.files import written


def component_labels(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component); edges has columns u and v."""
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "labels")
    while True:
        seen = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = labels.join(jump, "root").join(seen, F.col("node") == F.col("u")).select(
            "node", F.least("root", "near", "far").alias("next"), "root"
        )
        moved = written(moved, "labels")
        changed = moved.where("next <> root").isEmpty()
        labels = moved.select("node", F.col("next").alias("root"))
        if changed:
            return labels


def largest_component_share(edges: DataFrame) -> DataFrame:
    """Number of components and the share of edges in the one with the most; one row."""
    labels = component_labels(edges)
    per = edges.join(labels, edges["u"] == labels["node"]).groupBy("root").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_components"), (F.max("n") / F.sum("n")).alias("share"))
