"""Connected components kept as labels: trees of hooked nodes, flattened by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


#: Parents looked up in one job.
STRIDE = 3


def roots(forest: DataFrame) -> DataFrame:
    """(node, up) with the root above each node, from one parent ``up`` for a node and no cycles.

    A root itself has no row.  Each round goes up ``STRIDE`` parents, so that paths shorten to
    a quarter; a round makes one row a node.
    """
    now = forest.select("node", "up")
    while True:
        new = now
        for _ in range(STRIDE):
            over = now.select(F.col("node").alias("up"), F.col("up").alias("over"))
            new = new.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved"))
        new = materialize(new, "forest")
        now = new.select("node", "up")
        if not new.where("moved").head(1):
            return now


def join_labels(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) after the links join the components of ``labels``, which names every node.

    Only links between different components count.  In each round a component hooks on to the
    least it is linked to if that is less than itself, trees are flattened, and the links are
    carried over to their roots, until none is left between two; at least half of the linked
    components go in a round.
    """
    spark = labels.sparkSession

    def between(edges: DataFrame, to: DataFrame, node: str, comp: str) -> DataFrame:
        for side in "ab":
            edges = edges.join(to.select(F.col(node).alias(side), F.col(comp).alias("to_")), side, "left").withColumn(side, F.coalesce("to_", side)).drop("to_")
        return materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    edges, changed = between(links.select(F.col(a).alias("a"), F.col(b).alias("b")), labels, "node", "comp"), False
    while edges.head(1):
        to, changed = roots(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))), True
        labels = labels.join(to.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        rest = between(edges, to, "node", "up")
        drop_materialized(spark, edges)
        edges = rest
    return materialize(labels, "labels") if changed else labels


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each node of an edge table; nodes of one component have one of them as ``comp``."""
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    return join_labels(materialize(nodes.select("node", F.col("node").alias("comp")), "labels"), edges, a, b)
