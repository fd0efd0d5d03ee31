"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _to_roots(up: DataFrame) -> DataFrame:
    """(`node`, `up`) with `up` moved to the end of its chain; each step doubles what a pointer spans."""
    while True:
        over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
        up = written(up.join(over, "up").select("node", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("node", "up")


def components(links: DataFrame) -> DataFrame:
    """(`node`, `root`): the least node reachable, for every node of `links` (`a`, `b`, any order, no nulls).

    In each round every node chooses its least neighbour. Such choices can only circle between two nodes, the lesser of which
    becomes a root; chains are followed to their roots by doubling, and the links are rewritten between
    roots. Every node of a round joins another, so the nodes at least halve: log2 rounds of log2 steps, whatever the shape. Nothing but
    emptiness reaches the driver. An empty link table gives an empty result.
    """
    links, names = written(links.select("a", "b").where("a <> b").distinct()), None
    while names is None or not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("up")).union(links.select("b", "a"))
        chosen = written(both.groupBy("node").agg(F.min("up").alias("up")))
        back = chosen.select(F.col("node").alias("up"), F.col("up").alias("back"))
        up = chosen.join(back, "up").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"))
        up = _to_roots(up)
        if names is None:
            names = up.withColumnRenamed("up", "root")
        else:
            names = written(names.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        links = written(ends.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    least = names.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("least"))
    return names.join(least, "root").select("node", F.col("least").alias("root"))
