"""Routing quality and cost scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routecast.functions.expr import scaled_tokens

MULTIPLIERS = (0.5, 1.0, 2.0)
RETRIES = 6


def mean_lengths(generations: DataFrame, ids: DataFrame, key: str = "question_id") -> DataFrame:
    """Mean output tokens over the repeats of the wanted ids."""
    return generations.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.avg("output_tokens").alias("mean_tokens"), F.count(F.lit(1)).alias("repeats"))


def scenario_items(predictions: DataFrame, labels: DataFrame, lengths: DataFrame, key: str = "question_id") -> DataFrame:
    """Predictions beside labels and mean length."""
    return predictions.join(labels, key).join(lengths.select(key, "mean_tokens"), key)


def costs(lengths: DataFrame, rates: DataFrame, multipliers: tuple[float, ...] = MULTIPLIERS) -> DataFrame:
    """(model, multiplier, tokens, low, high) Wh for each distinct token number; `rates` has model, low, high per token."""
    m = F.explode(F.array(*[F.lit(x) for x in multipliers])).alias("multiplier")
    tokens = lengths.select("mean_tokens", m).select("multiplier", scaled_tokens(F.col("mean_tokens"), F.col("multiplier")).alias("tokens")).distinct()
    return tokens.crossJoin(F.broadcast(rates)).select("model", "multiplier", "tokens", (F.col("tokens") * F.col("low")).alias("low"), (F.col("tokens") * F.col("high")).alias("high"))  # a table of model rates


def expected_attempts(p: Column, most: Column | int) -> Column:
    """Sum of (1 - p)^i for i below `most`; `most` itself at p = 0."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(most) - 1 if isinstance(most, int) else most - 1), F.lit(0.0), lambda a, i: a + F.pow(1 - p, i))


def second_moment(p: Column, most: Column) -> Column:
    """Of the number of attempts, sum of (2 i + 1) (1 - p)^i."""
    return F.aggregate(F.sequence(F.lit(0), most - 1), F.lit(0.0), lambda a, i: a + (2 * i + 1) * F.pow(1 - p, i))


def cost_grid(items: DataFrame, policies: list[str], rates: DataFrame, local_wh: float, overheads: dict[str, float], multipliers: tuple[float, ...] = MULTIPLIERS, retries: int = RETRIES) -> DataFrame:
    """Mean Wh and success per policy, scenario, retries, multiplier, estimate (low, high), overhead and category (null: all).

    `items` has question_id, category, correct_count, k, mean_tokens and a boolean column per policy (true: local). Scenarios:
    all_cloud, commit (local answers count as they are) and fallback (up to L local attempts, then cloud). Overhead
    applies to every request of a policy that names one. Categories appear at multiplier 1 only. Items and their token numbers are
    summed as whole numbers per distinct (correct_count, k) before rates and attempts multiply them, so the grid grows with
    distinct counts and not with rows; means are rounded to 9 places, which no order of summation changes.
    """
    m = F.explode(F.array(*[F.lit(x) for x in multipliers])).alias("multiplier")
    base = items.select("category", "correct_count", "k", *policies, "mean_tokens", m).withColumn("tokens", scaled_tokens(F.col("mean_tokens"), F.col("multiplier")).cast("long"))
    named = F.explode(F.array(F.struct(F.lit("all_cloud").alias("policy"), F.lit(False).alias("local"), F.lit(0.0).alias("overhead")), *[
        F.struct(F.lit(n).alias("policy"), F.col(n).alias("local"), F.lit(o).alias("overhead")) for n in policies for o in dict.fromkeys([overheads.get(n, 0.0), 0.0])])).alias("x")
    rows = base.groupBy("category", "correct_count", "k", "multiplier", *policies).agg(F.count(F.lit(1)).alias("w"), F.sum("tokens").alias("t"))
    rows = rows.select("category", (F.col("correct_count") / F.col("k")).alias("p"), "multiplier", "w", "t", named).select("category", "p", "multiplier", "w", "t", "x.*")
    rows = rows.crossJoin(F.broadcast(rates.select("low", "high")))  # one row: the cloud model's rates
    tries = F.explode(F.when(F.col("policy") == "all_cloud", F.array(F.struct(F.lit("all_cloud").alias("scenario"), F.lit(0).alias("attempts")))).otherwise(F.array(
        F.struct(F.lit("commit").alias("scenario"), F.lit(1).alias("attempts")), *[F.struct(F.lit("fallback").alias("scenario"), F.lit(i).alias("attempts")) for i in range(1, retries + 1)]))).alias("s")
    rows = rows.select("*", tries).select("category", "p", "multiplier", "policy", "local", "overhead", "w", "t", "low", "high", "s.*")
    bound = F.explode(F.array(F.struct(F.lit("low").alias("estimate"), F.col("low").alias("rate")), F.struct(F.lit("high").alias("estimate"), F.col("high").alias("rate")))).alias("e")
    rows = rows.select("*", bound).select("category", "p", "multiplier", "policy", "local", "overhead", "w", "t", "scenario", "attempts", "e.*")
    fall, cloud = F.col("scenario") == "fallback", F.col("t") * F.col("rate")
    left = F.pow(1 - F.col("p"), F.col("attempts"))
    wh = F.when(~F.col("local"), cloud).when(fall, expected_attempts(F.col("p"), F.col("attempts")) * local_wh * F.col("w") + left * cloud).otherwise(F.lit(local_wh) * F.col("w")) + F.col("overhead") * F.col("w")
    success = F.when(F.col("local") & ~fall, F.col("p") * F.col("w")).otherwise(F.col("w").cast("double"))
    rows = rows.select("category", "multiplier", "policy", "overhead", "scenario", "attempts", "estimate", "w", F.when(F.col("local"), F.col("w")).otherwise(0).alias("at_home"), cloud.alias("cloud"), wh.alias("wh"), success.alias("success"))
    keys = ["multiplier", "policy", "overhead", "scenario", "attempts", "estimate"]
    mean = lambda c: F.sum(c) / F.sum("w")
    g = rows.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in [*keys, "category"]]], *[F.col(k) for k in keys], F.col("category")).agg(
        F.sum("w").alias("n"), mean("wh").alias("wh"), mean("success").alias("success"), mean("cloud").alias("all_cloud_wh"), mean("at_home").alias("local_share"),
        F.grouping("category").alias("_whole"))
    g = g.where((F.col("_whole") == 1) | (F.col("multiplier") == 1.0)).drop("_whole")
    g = g.withColumns({"wh_saved": F.col("all_cloud_wh") - F.col("wh"), "relative": F.try_divide("wh", "all_cloud_wh")})
    return g.withColumns({c: F.round(c, 9) for c in ("wh", "success", "all_cloud_wh", "local_share", "wh_saved", "relative")})


def uniforms(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from md5 of the seed and the parts."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def endpoint_pairs(grid: DataFrame, keys: list[str], value: str = "wh", estimate: str = "estimate") -> DataFrame:
    """(keys, low, high, fault): exactly one row per end and low at most high."""
    g = grid.groupBy(*keys).pivot(estimate, ["low", "high"]).agg(F.max(value).alias("v"), F.count(value).alias("n"))
    fault = F.when((F.coalesce("low_n", F.lit(0)) != 1) | (F.coalesce("high_n", F.lit(0)) != 1), "count").when(F.col("low_v") > F.col("high_v"), "order")
    return g.select(*keys, F.col("low_v").alias("low"), F.col("high_v").alias("high"), fault.alias("fault"))


def baseline_faults(grid: DataFrame, values: list[str], estimate: str = "estimate") -> DataFrame:
    """(estimate, fault) of baseline rows that are repeated with other values, or whose success is not 1."""
    g = grid.groupBy(estimate).agg(F.count_distinct(F.struct(*values)).alias("n"), F.min("success").alias("s"))
    return g.select(estimate, F.when(F.col("n") != 1, "differs").when(F.col("s") != 1, "success").alias("fault")).where("fault is not null")


def close(a: Column, b: Column | float, rel: float = 1e-10, absolute: float = 1e-12) -> Column:
    """Within max(absolute, rel * larger magnitude)."""
    b = F.lit(b) if not isinstance(b, Column) else b
    return F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b)))


def selected(grid: DataFrame, category: str | None, multiplier: float, overhead: float) -> DataFrame:
    """Rows of one category (null: all), multiplier and overhead."""
    where = F.col("category").isNull() if category is None else F.col("category") == category
    return grid.where(where & close(F.col("multiplier"), multiplier) & close(F.col("overhead"), overhead))


def panel_table(grid: DataFrame, policy: str, retries: int = RETRIES) -> DataFrame:
    """Baseline, committed and fallback pairs of one policy; missing retries have null ends."""
    g = grid.where(F.col("policy").isin(policy, "all_cloud"))
    p = endpoint_pairs(g, ["scenario", "attempts"])
    want = [("all_cloud", 0), ("commit", 1)] + [("fallback", i) for i in range(1, retries + 1)]
    return grid.sparkSession.createDataFrame(want, "scenario string, attempts int").join(p, ["scenario", "attempts"], "left")
