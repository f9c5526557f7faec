"""Connected components with DataFrame operations only, for graphs of any size and hubs of any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksift.plans.storage import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b`` of one orderable type); the
    component is its smallest node. Loops, repeated and null-ended edges are harmless.

    Each round maps every node to the first of itself and its neighbours in a hashed order, and
    replaces edges by the edges between these; a constant share of nodes vanishes per round, so the
    rounds are logarithmic, also on long chains. Neighbours are never gathered: a hub is one
    partial minimum per task, and the joins back can be split by adaptive execution.
    """
    cur = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = written(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct()
        .withColumn("root", F.col("node")),
        "labels",
    )
    while not cur.isEmpty():
        both = cur.union(cur.select("b", "a"))
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        parent = (
            both.groupBy("a").agg(F.min(first("b")).alias("m"))
            .select(F.col("a").alias("was"), F.least(F.col("m"), first("a"))["n"].alias("now"))
        )
        parent = written(parent, "parents")
        moved = (
            cur.join(parent.withColumnRenamed("was", "a"), "a").select(F.col("now").alias("a"), "b")
            .join(parent.withColumnRenamed("was", "b"), "b").select("a", F.col("now").alias("b"))
        )
        cur = written(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = written(
            labels.join(parent.withColumnRenamed("was", "root"), "root", "left")
            .select("node", F.coalesce("now", "root").alias("root")),
            "labels",
        )
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")
