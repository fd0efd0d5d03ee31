"""Counters, passes and run telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecast.operators.prefix import preceding


def counter_deltas(samples: DataFrame, domain: str = "domain", seq: tuple[str, ...] = ("ts",), scale: float = 1.0) -> DataFrame:
    """(domain, samples, wraps, total): increments of a cumulative counter; a fall means that it wrapped at max_range. No domain needs one task."""
    s = preceding(samples.select(domain, *seq, "value", "max_range"), list(seq), "value", "_was", [domain]).withColumn("_d", F.col("value") - F.col("_was"))
    step = F.when(F.col("_d") < 0, F.col("_d") + F.col("max_range")).otherwise(F.col("_d"))
    return s.groupBy(domain).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("_d") < 0).alias("wraps"), (F.coalesce(F.sum(step), F.lit(0)) * scale).alias("total"))


def marginal(passes: DataFrame, idle: DataFrame) -> DataFrame:
    """Gross minus idle scaled to the pass' duration; `valid` is false where nothing is left. `idle` has one row (seconds, energy)."""
    i = idle.select(F.col("seconds").alias("_is"), F.col("energy").alias("_ie"))
    net = F.col("energy") - F.col("_ie") * F.try_divide("seconds", "_is")
    return passes.crossJoin(F.broadcast(i)).select("pass", "seconds", "energy", net.alias("net"), F.coalesce(net > 0, F.lit(False)).alias("valid"))  # one idle row


def telemetry_faults(rows: DataFrame, project: str) -> DataFrame:
    """T5: (rule, n) of telemetry rows (project, version, duration, energy); an empty table is the fault `rows`."""
    from routecast.operators.checks import violations

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bad = violations(rows, {"project": F.col("project") == project, "duration": finite("duration") & (F.col("duration") > 0), "energy": finite("energy") & (F.col("energy") >= 0)})
    whole = rows.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("version").alias("v"))
    return bad.union(whole.where("c = 0").select(F.lit("rows").alias("rule"), F.lit(1).cast("long").alias("n"))).union(whole.where("v > 1").select(F.lit("version").alias("rule"), F.col("v").alias("n")))


def pass_totals(passes: DataFrame) -> DataFrame:
    """Per pass and in all (`pass` null): totals, ratios from totals, SD over passes (0 with one), whether checksums agree.

    passes: pass, queries, seconds, energy (Wh), checksum.
    """
    g = passes.groupingSets([[F.col("pass")], []], F.col("pass")).agg(
        F.sum("queries").alias("queries"), F.sum("seconds").alias("seconds"), F.sum("energy").alias("energy"),
        F.coalesce(F.stddev_samp(F.col("energy") / F.col("queries")), F.lit(0.0)).alias("sd_per_query"), (F.count_distinct("checksum") == 1).alias("same_checksum"))
    return g.withColumns({"energy_per_query": F.try_divide("energy", "queries"), "seconds_per_query": F.try_divide("seconds", "queries"), "watts": F.try_divide(F.col("energy") * 3600, F.col("seconds"))})
