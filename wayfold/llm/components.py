"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of each vertex in ``edges`` (a, b); root is the least vertex of its component.

    Each round takes the least label among neighbours and then the label's own label, until no label changes: the
    rounds grow with the logarithm of a component's diameter. Labels are a table in the shared folder after each
    round, which takes the place of the one before; nothing but the number of changes reaches the driver. Joins are of
    plain shuffles on one side at least, so that Spark can split a hot vertex or root.
    """
    edges = scratch.staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.staged(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        new = labels.join(near, "v").select("v", F.least("root", "near").alias("up"), F.col("root").alias("old"))
        jump = labels.select(F.col("v").alias("up"), F.col("root").alias("top"))
        old, labels = labels, scratch.staged(new.join(jump, "up").select("v", F.least("up", "top").alias("root"), (F.least("up", "top") != F.col("old")).alias("changed")), "labels")
        scratch.drop(old)
        if not labels.filter("changed").limit(1).count():
            scratch.drop(edges)
            return labels.select("v", "root")


def joined(roots: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of components() with the further ``edges`` (a, b), from its result so far.

    Only edges between different components count, each as one between their roots: their number, not that of the
    vertices, is what the rounds work on.
    """
    ends = edges.select("a", "b").join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "left")
    ends = ends.join(roots.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b", "left")
    between = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    top = components(scratch.staged(between, "between"), scratch)
    # a vertex that had no edge before is in ``top`` by itself
    known = roots.join(top.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    fresh = top.join(roots.select("v"), "v", "left_anti").select("v", "root")
    return scratch.staged(known.unionByName(fresh), "joined")
