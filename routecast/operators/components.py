"""Connected components of a table of links by hooking and contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecast.sources.shared import written


def to_roots(up: DataFrame) -> DataFrame:
    """(node, up) with `up` moved to the end of its chain. Roots point to themselves; every step doubles what a pointer spans.

    Pointers that have arrived are left out of the further steps, so that the many that meet in one root are joined once.
    """
    arrived, left = [up.where("node = up")], written(up.where("node <> up"))
    while not left.isEmpty():
        over = left.select(F.col("node").alias("up"), F.col("up").alias("over"))
        moved = written(left.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNull().alias("there")))
        arrived.append(moved.where("there").select("node", "up"))
        left = moved.where("not there").select("node", "up")
    return reduce(DataFrame.unionByName, arrived)


def contracted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (node, root) of every node of `links` (a < b, distinct), and the links between roots.

    Every node hooks onto its least neighbour. Hooks can only circle between two nodes, the lesser of which becomes a root, so each
    root takes in another node at least and the nodes halve at least, in whatever order they are named.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("up")))
    hooks = written(both.groupBy("node").agg(F.min("up").alias("up")))
    back = hooks.select(F.col("node").alias("up"), F.col("up").alias("back"))
    root = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
    up = written(to_roots(hooks.join(back, "up").select("node", F.when(root, F.col("node")).otherwise(F.col("up")).alias("up"))))
    end = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"u{c}"))
    ends = links.join(end("a"), "a").join(end("b"), "b").where("ua <> ub")
    return up.withColumnRenamed("up", "root"), written(ends.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of `links` (a, b, in any order).

    Rounds of `contracted` until no link is left: at most log2 of the nodes, each with log2 steps. Links with a null end link nothing; a
    table without links gives no row. Only emptiness is told to the driver.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links, names = written(links.distinct()), None
    while names is None or not links.isEmpty():
        roots, links = contracted(links)
        if names is None:
            names = roots
        else:
            over = roots.select(F.col("node").alias("root"), F.col("root").alias("over"))
            names = written(names.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")))
    least = names.groupBy("root").agg(F.min("node").alias("least"))
    return names.join(least, "root").select("node", F.least("least", "root").alias("root"))
