"""Connected components of a graph of links, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(_node, _comp) for each node of ``links`` (_a, _b: long), _comp the same for connected nodes.

    Each round every node points to its smallest neighbour or itself, pointers are followed
    twice, and the links between what they point to are the next round's graph; it shrinks
    to nothing in a few rounds. Every round is written, so lineage stays short. A hub with
    very many links is a hot join key, which AQE splits, and is folded by partial aggregates.
    """
    graph = common.stored(links.where("_a <> _b").select("_a", "_b").distinct(), "links")
    labels = common.stored(graph.select(F.col("_a").alias("_node")).union(graph.select("_b")).distinct().withColumn("_comp", F.col("_node")), "labels")
    while not graph.isEmpty():
        both = graph.union(graph.select("_b", "_a"))
        least = both.groupBy(F.col("_a").alias("_from")).agg(F.min("_b").alias("_least"))
        point = common.stored(least.select("_from", F.least("_from", "_least").alias("_to")), "pointers")
        for _ in range(2):
            after = point.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
            point = point.join(after, F.col("_to") == F.col("_mid")).select("_from", F.col("_end").alias("_to"))
        point = common.stored(point, "pointers")
        labels = common.stored(labels.join(point, F.col("_comp") == F.col("_from"), "left").select("_node", F.coalesce("_to", "_comp").alias("_comp")), "labels")
        left = graph.join(point, F.col("_a") == F.col("_from")).select(F.col("_to").alias("_a"), "_b")
        graph = left.join(point, F.col("_b") == F.col("_from")).select("_a", F.col("_to").alias("_b")).where("_a <> _b")
        graph = common.stored(graph.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "links")
    return labels
