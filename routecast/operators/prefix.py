"""Running sums, preceding rows and quantiles in the order of a value, over any number of tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routecast.sources.shared import written


def _same(group: list[str], also: Column) -> Column:
    """The group's columns equal their copies `_g0`, `_g1`, ..., nulls included, and `also` holds."""
    return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], also)


def running(df: DataFrame, value: str, sums: list[str], group: list[str] = ()) -> DataFrame:
    """`df` with `<s>_upto` (over values up to the row's own) and `<s>_all` (over its group) for each column s of `sums`.

    `df` has one row per (group, value). Rows are range-partitioned by group and value, so a group of any size spreads over tasks; each
    task sums its own stretch, and the totals of the stretches, one row a task and group, are all that meets in one place.
    """
    group = list(group)
    d = written(df.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()))
    stretch = d.groupBy(*group, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    whole = Window.partitionBy(*(group or [F.lit(1)]))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = stretch.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_at"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
                          *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums])
    same = _same(group, F.col("_part") == F.col("_at"))
    inside = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.join(ends, same)
    return out.select(*df.columns, *[(F.sum(s).over(inside) + F.col(f"_before_{s}")).alias(f"{s}_upto") for s in sums], *[f"{s}_all" for s in sums])


def preceding(df: DataFrame, order: list[str], carry: str, out: str, group: list[str]) -> DataFrame:
    """`df` with `out`, the value of `carry` in the row before in its group by `order` (null in the first).

    Rows are range-partitioned by group and order, so a group of any size spreads over tasks; one row a task and group, its last, is
    all that meets in one place. Rows equal in group and order share a task and come in any order.
    """
    d = written(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    ends = d.groupBy(*group, "_part").agg(F.max_by(carry, F.struct(*order)).alias("_last"))
    ends = ends.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_at"), F.lag("_last").over(Window.partitionBy(*group).orderBy("_part")).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    value = F.when(F.row_number().over(inside) == 1, F.col("_before")).otherwise(F.lag(carry).over(inside))
    return d.join(ends, _same(group, F.col("_part") == F.col("_at"))).select(*df.columns, value.alias(out))


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], group: list[str] = ()) -> DataFrame:
    """One row a group of linear quantiles of the non-null values, by name; without values null, or no row if there is a group.

    Counts per distinct value, running counts, and the two values around each wanted place: no buffer holds a group's values.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    r = running(counts, "_v", ["_n"], group)
    at = lambda place: F.max(F.when((F.col("_n_upto") > place) & (F.col("_n_upto") - F.col("_n") <= place), F.col("_v").cast("double")))
    place = {name: (F.col("_n_all") - 1) * F.lit(p) for name, p in wanted.items()}
    g = r.groupBy(*group).agg(*[x for name, c in place.items() for x in (at(F.floor(c)).alias(f"_lo_{name}"), at(F.ceil(c)).alias(f"_hi_{name}"), F.max(c - F.floor(c)).alias(f"_at_{name}"))])
    return g.select(*group, *[(F.col(f"_lo_{n}") * (1 - F.col(f"_at_{n}")) + F.col(f"_hi_{n}") * F.col(f"_at_{n}")).alias(n) for n in wanted])


def with_quantiles(base: DataFrame, df: DataFrame, value: str, wanted: dict[str, float], group: list[str] = ()) -> DataFrame:
    """`base`, one row a group, beside the quantiles of `df`."""
    q = quantiles(df, value, wanted, group)
    if not group:
        return base.crossJoin(q)  # one row each
    q = q.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *wanted)
    return base.join(q, _same(list(group), F.lit(True)), "left").select(*base.columns, *wanted)
