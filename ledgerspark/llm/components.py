"""Connected components by propagating the least label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Rows in a partition of what is kept between rounds; few rows need not be spread over all shuffle partitions.
ROWS = 100_000


def least_labels(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) for every node of links (a, b).

    A round takes the least label among a node and its neighbours, offers it to the node's label too, and then takes
    that label's own label: the number of rounds grows with the logarithm of the longest path.  Every round is a checkpoint; the driver learns only how many labels changed."""
    edges = fresh(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct())
    n = 1 + edges.count() // ROWS
    edges = edges.coalesce(n)
    labels = fresh(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(n))
    while True:
        named = edges.join(labels.withColumnsRenamed({"node": "b", "label": "to"}), "b").join(labels.withColumnsRenamed({"node": "a", "label": "of"}), "a")
        # a neighbour's label is offered to the node and to the node's own label, so whole trees join at once
        offers = named.select(F.explode(F.array_distinct(F.array("a", "of"))).alias("node"), F.col("to").alias("label"))
        near = offers.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = fresh(near.join(target, "label", "left").select("node", F.least("label", "beyond").alias("label")).coalesce(n))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label < old").limit(1).count()
        labels = new
        if not changed:
            return labels
