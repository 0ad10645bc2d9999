"""Connected components of a link table, distributed and without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the least node reachable.

    Each round gives every node the least label among its own and its
    neighbours', then replaces labels by their labels' labels (pointer
    jumping), so rounds grow with the logarithm of the longest path.  Links are
    written in both directions, so a round joins them once, and labels with the
    ones before, so that a look at them tells whether any changed.  The joins
    have plain exchanges on both sides, which adaptive execution splits where a
    node has very many links.  ``most`` bounds the nodes, if it is known.
    """
    pairs = links.select("a", "b").filter("a != b").distinct()
    ends = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links", None if most is None else 2 * most)
    labels = written(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels", most)
    while True:
        own = labels.select("node", "label", F.col("label").alias("old"))
        near = ends.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        low = written(own.unionByName(near).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels", most)
        up = low.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = written(low.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), "old"), "labels", most)
        changed = not jumped.filter("label != old").isEmpty()
        drop_written(low)
        drop_written(labels)
        labels = jumped
        if not changed:
            drop_written(ends)
            return labels.select("node", F.col("label").alias("component"))


def relabelled(labels: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """The components of ``labels`` (node, component) joined by more links (a, b) between nodes, those without a label included.

    The links are taken between components, so the graph that is walked is the
    small one of what is left to join.
    """
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    up = components(between, most)
    above = up.select(F.col("node").alias("component"), F.col("component").alias("above"))
    old = labels.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    new = up.join(labels.select("node"), "node", "left_anti")
    return written(old.unionByName(new), "labels", most)
