"""Queries of routing and cost scenarios, counters and telemetry (E, T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.operators import scenarios as E
from routecast.operators import telemetry as T
from routecast.plans.views import counters, forecasts, over, read, trials
from routecast.registry import query

RATES = [("cloud", 0.002, 0.005)]
LOCAL, OVERHEAD = 0.05, {"classifier": 0.001}


def _items(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    base = E.scenario_items(f.select("question_id", "category", "probability"), f.select("question_id", "correct_count", "k"), E.mean_lengths(trials(spark, d), f))
    return base.withColumns({"classifier": F.col("probability") >= 0.5, "oracle": F.col("correct_count") * 2 >= F.col("k")})


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "model string, low double, high double")


ITEMS = ", i AS (SELECT question_id, category, correct_count, k, probability, mean_tokens, probability >= 0.5e0 AS classifier, 2 * correct_count >= k AS oracle FROM forecasts JOIN (SELECT question_id, avg(output_tokens) AS mean_tokens FROM trials GROUP BY 1) USING (question_id))"
GRID = ITEMS + """, b AS (SELECT category, correct_count / CAST(k AS DOUBLE) AS p, m.v AS multiplier, floor(mean_tokens * m.v + 0.5e0) AS tokens, unnest([{'policy': 'all_cloud', 'local': false, 'overhead': 0e0}, {'policy': 'classifier', 'local': classifier, 'overhead': 0.001e0}, {'policy': 'classifier', 'local': classifier, 'overhead': 0e0}, {'policy': 'oracle', 'local': oracle, 'overhead': 0e0}]) AS x FROM i, (VALUES (0.5e0), (1e0), (2e0)) m(v)),
c AS (SELECT category, p, multiplier, tokens, x.policy AS policy, x.local AS local, x.overhead AS overhead, s.scenario AS scenario, s.attempts AS attempts FROM b, (SELECT unnest([{'scenario': 'all_cloud', 'attempts': 0}, {'scenario': 'commit', 'attempts': 1}, {'scenario': 'fallback', 'attempts': 1}, {'scenario': 'fallback', 'attempts': 2}, {'scenario': 'fallback', 'attempts': 3}, {'scenario': 'fallback', 'attempts': 4}, {'scenario': 'fallback', 'attempts': 5}, {'scenario': 'fallback', 'attempts': 6}]) AS s) WHERE (s.scenario = 'all_cloud') = (x.policy = 'all_cloud')),
e AS (SELECT *, tokens * r.rate AS cloud, r.estimate AS estimate FROM c, (VALUES ('low', 0.002e0), ('high', 0.005e0)) r(estimate, rate)),
w AS (SELECT *, overhead + CASE WHEN NOT local THEN cloud WHEN scenario = 'fallback' THEN (CASE WHEN p = 0 THEN attempts ELSE (1 - pow(1 - p, attempts)) / p END) * 0.05e0 + pow(1 - p, attempts) * cloud ELSE 0.05e0 END AS wh, CASE WHEN local AND scenario <> 'fallback' THEN p ELSE 1e0 END AS success FROM e),
g AS (SELECT multiplier, policy, overhead, scenario, attempts, estimate, category, count(*) AS n, avg(wh) AS wh, avg(success) AS success, avg(cloud) AS all_cloud_wh, avg(CASE WHEN local THEN 1e0 ELSE 0e0 END) AS local_share, grouping(category) AS gr FROM w GROUP BY GROUPING SETS ((multiplier, policy, overhead, scenario, attempts, estimate), (multiplier, policy, overhead, scenario, attempts, estimate, category))),
grid AS (SELECT multiplier, policy, overhead, scenario, attempts, estimate, category, n, round(wh, 9) AS wh, round(success, 9) AS success, round(all_cloud_wh, 9) AS all_cloud_wh, round(local_share, 9) AS local_share,
  round(all_cloud_wh - wh, 9) AS wh_saved, round(wh / all_cloud_wh, 9) AS relative FROM g WHERE gr = 1 OR multiplier = 1)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return E.cost_grid(_items(spark, d), ["classifier", "oracle"], _rates(spark), LOCAL, OVERHEAD)


@query("scenario_items", over("forecasts trials", ITEMS + " SELECT * FROM i"))
def scenario_items(spark: SparkSession, d: str) -> DataFrame:
    """E0, E1, E9."""
    return _items(spark, d)


@query("token_costs", over("trials", ", t AS (SELECT DISTINCT floor(m * v + 0.5e0) AS tokens, v AS multiplier FROM (SELECT avg(output_tokens) AS m FROM trials GROUP BY question_id), (VALUES (0.5e0), (1e0), (2e0)) x(v)) SELECT 'cloud' AS model, multiplier, CAST(tokens AS BIGINT) AS tokens, tokens * 0.002e0 AS low, tokens * 0.005e0 AS high FROM t"))
def token_costs(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    return E.costs(E.mean_lengths(t, t), _rates(spark))


@query("fallback_attempts", over("v_labels", "SELECT question_id, CASE WHEN correct_count = 0 THEN 4e0 ELSE (1 - pow(1 - correct_count / CAST(k AS DOUBLE), 4)) / (correct_count / CAST(k AS DOUBLE)) END AS attempts FROM v_labels"))
def fallback_attempts(spark: SparkSession, d: str) -> DataFrame:
    from routecast.plans.views import v_labels

    return v_labels(spark, d).select("question_id", E.expected_attempts(F.col("correct_count") / F.col("k"), 4).alias("attempts"))


@query("cost_grid", over("forecasts trials", GRID + " SELECT * FROM grid"))
def cost_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


PAIR = "max(wh) FILTER (estimate = 'low') AS low, max(wh) FILTER (estimate = 'high') AS high"


@query("endpoint_pairs", over("forecasts trials", GRID + f" SELECT policy, overhead, scenario, attempts, multiplier, {PAIR}, CAST(NULL AS VARCHAR) AS fault FROM grid WHERE category IS NULL GROUP BY ALL"))
def endpoint_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.endpoint_pairs(_grid(spark, d).where("category is null"), ["policy", "overhead", "scenario", "attempts", "multiplier"])


@query("baseline_faults", over("forecasts trials", GRID + " SELECT estimate, 'differs' AS fault FROM grid WHERE policy = 'all_cloud' AND category IS NULL GROUP BY 1"))
def baseline_faults(spark: SparkSession, d: str) -> DataFrame:
    """E11 on the baseline of all three multipliers, whose rows must differ."""
    return E.baseline_faults(_grid(spark, d).where("policy = 'all_cloud' and category is null"), ["wh", "success"])


@query("selected_rows", over("forecasts trials", GRID + " SELECT policy, scenario, attempts, estimate, wh FROM grid WHERE category = 'ECONOMY' AND multiplier = 1 AND overhead = 0"))
def selected_rows(spark: SparkSession, d: str) -> DataFrame:
    """E12."""
    return E.selected(_grid(spark, d), "ECONOMY", 1.0, 0.0).select("policy", "scenario", "attempts", "estimate", "wh")


@query("panel_table", over("forecasts trials", GRID + f" SELECT scenario, attempts, {PAIR}, CAST(NULL AS VARCHAR) AS fault FROM grid WHERE category IS NULL AND multiplier = 1 AND policy IN ('oracle', 'all_cloud') GROUP BY ALL"))
def panel_table(spark: SparkSession, d: str) -> DataFrame:
    """E13."""
    return E.panel_table(_grid(spark, d).where("category is null and multiplier = 1"), "oracle")


@query("counter_delta", over("counters", """, s AS (SELECT domain, value - lag(value) OVER (PARTITION BY domain ORDER BY ts, event_id) AS d, max_range FROM counters)
SELECT domain, count(*) AS samples, count(*) FILTER (d < 0) AS wraps, CAST(coalesce(sum(CASE WHEN d < 0 THEN d + max_range ELSE d END), 0) AS DOUBLE) AS total FROM s GROUP BY 1"""))
def counter_delta(spark: SparkSession, d: str) -> DataFrame:
    return T.counter_deltas(counters(spark, d), seq=("ts", "event_id"), scale=1.0)


PASSES = "(SELECT user_id % 3 AS pass, count(*) AS queries, count(*) * 0.5e0 AS seconds, sum(value) AS energy, 'x' AS checksum FROM events WHERE event_type <> 'error' GROUP BY 1)"


def _passes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("event_type <> 'error'")
    return e.groupBy((F.col("user_id") % 3).alias("pass")).agg(F.count(F.lit(1)).alias("queries"), (F.count(F.lit(1)) * F.lit(0.5)).alias("seconds"), F.sum("value").alias("energy"), F.lit("x").alias("checksum"))


@query("pass_marginal", f'WITH i AS (SELECT count(*) * 0.5e0 AS s, sum(value) AS e FROM events WHERE event_type = \'error\') SELECT pass, seconds, energy, energy - e * (seconds / s) AS net, energy - e * (seconds / s) > 0 AS valid FROM {PASSES}, i')
def pass_marginal(spark: SparkSession, d: str) -> DataFrame:
    """T2 with the error events as the idle window."""
    idle = read(spark, d, "events").where("event_type = 'error'").agg((F.count(F.lit(1)) * F.lit(0.5)).alias("seconds"), F.sum("value").alias("energy"))
    return T.marginal(_passes(spark, d), idle)


@query("telemetry_faults", "SELECT * FROM (SELECT 'duration' AS rule, count(*) AS n FROM events WHERE value <= 5 UNION ALL SELECT 'project', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'version', count(DISTINCT user_id % 2) FROM events) WHERE n > 0")
def telemetry_faults(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.when(F.col("event_type") == "error", "other").otherwise("study").alias("project"), (F.col("user_id") % 2).alias("version"), (F.col("value") - 5).alias("duration"), F.lit(1.0).alias("energy"))
    return T.telemetry_faults(e, "study")


@query("pass_totals", f"SELECT pass, CAST(sum(queries) AS BIGINT) AS queries, sum(seconds) AS seconds, sum(energy) AS energy, coalesce(stddev_samp(energy / queries), 0) AS sd_per_query, count(DISTINCT checksum) = 1 AS same_checksum, sum(energy) / sum(queries) AS energy_per_query, sum(seconds) / sum(queries) AS seconds_per_query, sum(energy) * 3600 / sum(seconds) AS watts FROM {PASSES} GROUP BY GROUPING SETS ((pass), ())")
def pass_totals(spark: SparkSession, d: str) -> DataFrame:
    return T.pass_totals(_passes(spark, d))
