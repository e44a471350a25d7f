"""Connected components of link tables: union-find as joins, by hooking and path compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapkit.llm.shared import stored


def _compressed(parent: DataFrame) -> DataFrame:
    """Replace each parent by its root; the distance to the root halves in each pass."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        step = stored(
            parent.join(up, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"),
                                                     (F.coalesce("up", "parent") != F.col("parent")).alias("moved")),
            "parents",
        )
        parent = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return parent


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link, the component being its smallest node.

    Each round hooks a node to its smallest neighbour if that is smaller, compresses the paths, and contracts the links to
    roots. Every linked root but the smallest of its neighbourhood is hooked, so roots at least halve in each round.
    Everything is a table in the shared folder; nothing comes to the driver. Links with a null end and links of a node
    with itself say nothing and are left out.
    """
    edges = stored(
        links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "links"
    )
    labels = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).limit(0)
    first = True
    while not edges.isEmpty():
        sides = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(
            edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        parent = _compressed(stored(
            sides.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), "parents"))
        if first:
            labels, first = parent.withColumnRenamed("parent", "component"), False
        else:
            labels = labels.join(parent.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component"))
        lo = parent.select(F.col("node").alias("lo"), F.col("parent").alias("x"))
        hi = parent.select(F.col("node").alias("hi"), F.col("parent").alias("y"))
        edges = stored(
            edges.join(lo, "lo").join(hi, "hi").where("x <> y")
            .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "links")
    return labels
