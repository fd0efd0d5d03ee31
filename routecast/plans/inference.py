"""Queries of resampling, regression and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.functions.expr import probability_level, truth_level
from routecast.operators import inference as I
from routecast.plans.views import forecasts, items, over, participants, probability, v_labels
from routecast.registry import query


@query("bootstrap_kappa")
def bootstrap_kappa(spark: SparkSession, d: str) -> DataFrame:
    """M21; a resampling result, tested for coverage and against a plain loop."""
    f = forecasts(spark, d).select(truth_level(F.col("correct_count"), F.col("k")).alias("t"), probability_level(F.col("probability")).alias("s"))
    return I.bootstrap_kappa(I.cells(f, "t", "s"), 10_000, 20260728)


@query("paired_kappa_difference")
def paired_kappa_difference(spark: SparkSession, d: str) -> DataFrame:
    """M21 for two forecasters on the same items."""
    f = forecasts(spark, d)
    t = f.select(truth_level(F.col("correct_count"), F.col("k")).alias("truth"), probability_level(F.col("probability")).alias("one"), probability_level(probability(53)).alias("two"))
    return I.paired_difference(t, 10_000, 11)


@query("bootstrap_statistics")
def bootstrap_statistics(spark: SparkSession, d: str) -> DataFrame:
    """M21 for tau-b, pi and alpha: forecast against truth by level and by route, and three readings of an item. Tests compare with plain loops."""
    f = forecasts(spark, d)
    two = f.select(truth_level(F.col("correct_count"), F.col("k")).alias("t"), probability_level(F.col("probability")).alias("s"), probability_level(probability(53)).alias("u"))
    routes = two.select((F.col("t") >= 3).cast("int").alias("t"), (F.col("s") >= 3).cast("int").alias("s"))
    named = lambda name, df: df.select(F.lit(name).alias("statistic"), "*")
    return named("tau_b", I.bootstrap(two, ["t", "s"], "tau_b", 10_000, 5)).unionByName(named("alpha", I.bootstrap(two, ["t", "s", "u"], "alpha", 10_000, 5))).unionByName(
        named("pi", I.bootstrap(routes, ["t", "s"], "pi", 10_000, 5, levels=2)))


@query("ols_hc3", over("participants", """, m AS (SELECT count(*) AS n, avg(age) AS mx, avg(outcome) AS my, sum(age * age) - count(*) * avg(age) * avg(age) AS sxx FROM participants),
b AS (SELECT n, mx, my, sxx, (SELECT regr_slope(outcome, age) FROM participants) AS b FROM m), e AS (SELECT age, outcome - (my + b * (age - mx)) AS e, 1e0 / n + (age - mx) * (age - mx) / sxx AS h, n, mx, my, sxx, b FROM participants, b),
v AS (SELECT any_value(n) AS n, any_value(my - b * mx) AS a, any_value(b) AS b, sqrt(sum(pow(e / (1 - h), 2) * pow((age - mx) / sxx, 2))) AS sb, sqrt(sum(pow(e / (1 - h), 2) * pow(1e0 / n - mx * (age - mx) / sxx, 2))) AS sa, sum(e * e) AS rss FROM e)
SELECT term, coefficient, se, t, n, r2 FROM (SELECT unnest([{'term': 'intercept', 'coefficient': a, 'se': sa, 't': a / sa}, {'term': 'age', 'coefficient': b, 'se': sb, 't': b / sb}], recursive := true), n, 1 - rss / (SELECT (count(*) - 1) * var_samp(outcome) FROM participants) AS r2 FROM v)"""))
def ols_hc3(spark: SparkSession, d: str) -> DataFrame:
    return I.hc3(participants(spark, d), "outcome", ["age"]).select("term", "coefficient", "se", "t", "n", "r2")


@query("model_grid")
def model_grid(spark: SparkSession, d: str) -> DataFrame:
    """Several models with p-values and intervals; the single fit has an SQL form, this one is tested by hand."""
    p = participants(spark, d).withColumns({"older": (F.col("age") > 48).cast("double"), "half": F.when(F.col("participant_id") % 2 == 0, F.col("age") / 2.0)})
    return I.model_grid(p, {"age": ["age"], "joint": ["age", "older"], "gaps": ["half"]}, ["outcome"])


@query("mixture_by_segment")
def mixture_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """M28."""
    return I.rate_mixture(v_labels(spark, d).join(items(spark, d), "question_id").select("segment", "k", "correct_count"))
