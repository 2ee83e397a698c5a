"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirloom.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of links(a, b).

    Each round takes the smallest root among a node's neighbours, then jumps to the root's own
    root, so that stars need two rounds and paths about the logarithm of their length. Every
    round's labels are a table in the shared folder.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("a", "b"), "links")
    labels = durable(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "roots")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = durable(nearer.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
        if not after.where(F.col("was") != F.col("root")).limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")
