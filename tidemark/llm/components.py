"""Connected components of a large graph of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, materialize, only_result


@only_result
def components(links: DataFrame) -> DataFrame:
    """(node, label, was) of every node of ``links`` (a, b); the label is the least node of its component.

    Each round takes the least label among a node's neighbours (pre-aggregated), hands
    it to the node that gave the label so far as well, and then jumps to the label's own
    label, so rounds grow with the logarithm of the longest path, whatever the order of
    the nodes on it. Every round is one written table, and the one before goes; hubs are
    keys of joins that Spark may split, never groups. ``was``: equal to the label.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"), F.col("node").alias("was")))
    while not labels.where("label < was").isEmpty():
        known = labels.select("node", "label")
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = known.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hook = seen.groupBy(F.col("was").alias("node")).agg(F.min("label").alias("hook"))
        lower = seen.join(hook, "node", "left").select("node", "was", F.least("label", F.coalesce("hook", "label")).alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        before, labels = labels, materialize(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"))
        forget(before)
    return labels


@only_result
def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label, ...) after more ``links``: the components that they join are the nodes of a graph of their own."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    across = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = components(across)
    if over.isEmpty():
        return labels
    # A node without links so far is a component of its own.
    nodes = labels.select("node", "label").union(over.select("node", F.col("node").alias("label"))).distinct()
    return materialize(nodes.join(over.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label")))
