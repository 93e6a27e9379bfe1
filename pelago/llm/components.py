"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, outlives, scratch, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so the number of rounds follows the logarithm of the longest path. Every round is
    written, which cuts the lineage; nothing but counts comes to the driver. Nodes with many
    neighbours and labels with many nodes are joined by broadcast, see join_hot().
    """
    with scratch(links.sparkSession):
        there = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
        both = written(there.unionByName(there.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
        labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component"), F.count(F.lit(1)).alias("degree")), "labels")
        while True:
            seen = labels.select(F.col("node").alias("other"), F.col("component").alias("seen"), "degree")
            near = join_hot(both, seen, ["other"], "degree").groupBy("node").agg(F.min("seen").alias("seen"))
            least = written(labels.join(near, "node").select("node", F.least("component", "seen").alias("component"), F.col("component").alias("was"), "degree"), "least")
            sizes = least.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
            up = written(sizes.join(labels.select(F.col("node").alias("component"), F.col("component").alias("up")), "component"), "up")
            step = written(join_hot(least, up, ["component"], "size").select("node", F.least("component", "up").alias("component"), "was", "degree"), "labels")
            labels = step.select("node", "component", "degree")
            if step.where("component <> was").isEmpty():
                return outlives(labels.select("node", "component"), "components")
