"""Forecast scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routecast.operators.prefix import running, with_quantiles
from routecast.functions.expr import probability_level, truth_level
from routecast.operators.agreement import pair_descriptors, with_rates

CLIP = 1e-9


def nll(c: Column, k: Column, p: Column) -> Column:
    """M1, per row: -(c ln p + (k - c) ln(1 - p)) with p clipped."""
    q = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return -(c * F.ln(q) + (k - c) * F.log1p(-q))


def noise_floor(p: Column, k: Column) -> Column:
    """M3."""
    return F.sqrt(p * (1 - p) / k)


def rate_log_loss(c: Column, k: Column, p: Column) -> Column:
    """M12, per row: -(r ln p + (1 - r) ln(1 - p)), 0 ln 0 = 0; null where it is infinite."""
    r = c / k
    one = F.when(r == 0, 0.0).when(p > 0, r * F.ln(p))
    two = F.when(r == 1, 0.0).when(p < 1, (1 - r) * F.log1p(-p))
    return -(one + two)


def likelihoods(df: DataFrame, group: list[str] = ()) -> DataFrame:
    """Mean NLL, deviance, noise floor, MAE, Brier, RMSE and log loss of `probability` against c of k, per group.

    One aggregate over the rows. One infinite log loss makes that of the group null.
    """
    c, k, p = F.col("correct_count"), F.col("k"), F.col("probability")
    r, loss = c / k, rate_log_loss(c, k, p)
    g = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(nll(c, k, p)).alias("nll"), (2 * (F.avg(nll(c, k, p)) - F.avg(nll(c, k, r)))).alias("deviance"), F.avg(noise_floor(r, k)).alias("noise_floor"),
        F.avg(F.abs(p - r)).alias("mae"), F.avg((p - r) * (p - r)).alias("brier"), F.when(F.bool_and(loss.isNotNull()), F.avg(loss)).alias("log_loss"))
    return g.withColumn("rmse", F.sqrt("brier"))


def average_ranks(df: DataFrame, value: str, group: list[str], out: str) -> DataFrame:
    """(group, value, out): the average rank of each distinct value, from running counts over distinct values."""
    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return running(n, value, ["_n"], group).select(*group, value, (F.col("_n_upto") - (F.col("_n") - 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str, group: list[str] = ()) -> DataFrame:
    """M5: rank correlation with average ranks, within [-1, 1]; null if either side is constant.

    Equal (x, y) pairs are counted first, and pair counts carry the sums.
    """
    group = list(group)
    pairs = df.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("_n"))
    j = pairs.join(average_ranks(df, x, group, "_rx"), [*group, x]).join(average_ranks(df, y, group, "_ry"), [*group, y])
    w = lambda e: F.sum(F.col("_n") * e)
    a, b = F.col("_rx"), F.col("_ry")
    g = j.groupBy(*group).agg(F.sum("_n").alias("n"), w(a).alias("sx"), w(b).alias("sy"), w(a * a).alias("sxx"), w(b * b).alias("syy"), w(a * b).alias("sxy"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    rho = F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    return g.select(*group, "n", rho.alias("spearman"))


def routing(df: DataFrame, group: list[str] = (), threshold: Column | float = 0.5, label_threshold: float = 0.5) -> DataFrame:
    """M6: the 2x2 table and rates of routing at `threshold`, with macro F1 (null unless both classes occur)."""
    truth = F.col("correct_count") / F.col("k") >= label_threshold
    said = F.col("probability") >= threshold
    g = with_rates(df.groupBy(*group).agg(F.count_if(~truth & ~said).alias("tn"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(truth & said).alias("tp")))
    return g.withColumn("macro_f1", macro_f1())


def macro_f1() -> Column:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    both = (tp + fn > 0) & (tn + fp > 0)
    f = lambda hit: F.coalesce(F.try_divide(2 * hit, 2 * hit + fp + fn), F.lit(0.0))
    return F.when(both, (f(tp) + f(tn)) / 2)


def full_sweep(df: DataFrame, group: list[str] = (), extra: tuple[float, ...] = (0.0, 0.5, 0.7, 1.0)) -> DataFrame:
    """M8: the 2x2 table at every distinct probability and at `extra` thresholds, per group.

    Rows are counted per probability; running sums over those counts give every threshold at once.
    """
    group = list(group)
    truth = F.col("correct_count") * 2 >= F.col("k")
    by = df.groupBy(*group, F.col("probability").alias("threshold")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    more = df.select(*group).distinct() if group else df.sparkSession.range(1).select()
    more = more.select(*group, F.explode(F.array(*[F.lit(t) for t in extra])).alias("threshold"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    by = by.unionByName(more).groupBy(*group, "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = running(by, "threshold", ["pos", "neg"], group)
    tp, fp = F.col("pos_all") - F.col("pos_upto") + F.col("pos"), F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    c = c.select(*group, "threshold", (F.col("neg_all") - fp).alias("tn"), fp.alias("fp"), (F.col("pos_all") - tp).alias("fn"), tp.alias("tp"))
    return with_rates(c)


def fixed_sweep(df: DataFrame, group: list[str] = (), steps: int = 19) -> DataFrame:
    """M7: M6 at 0.05, 0.10, ..., computed as i * 0.05 + 0.05 in doubles and shown rounded to 3 places.

    Rows are reduced to counts per (probability, truth) before the thresholds multiply them.
    """
    truth = F.col("correct_count") / F.col("k") >= 0.5
    c = df.groupBy(*group, "probability", truth.alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(steps).select((F.col("id") * F.lit(0.05) + F.lit(0.05)).alias("t"))
    said, n = F.col("probability") >= F.col("t"), F.col("n")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    g = c.crossJoin(F.broadcast(grid)).groupBy(*group, F.round("t", 3).alias("threshold")).agg(  # a fixed grid of thresholds
        count(~F.col("truth") & ~said).alias("tn"), count(~F.col("truth") & said).alias("fp"), count(F.col("truth") & ~said).alias("fn"), count(F.col("truth") & said).alias("tp"))
    return with_rates(g).withColumn("macro_f1", macro_f1())


def operating_points(sweep: DataFrame, fpr: float = 0.1, fnr: float = 0.2) -> DataFrame:
    """M9."""
    return sweep.where((F.col("fpr") <= fpr) & (F.col("fnr") <= fnr))


def reliability_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_probability, mean_rate, gap) for all bins, empty ones with nulls."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg(F.col("correct_count") / F.col("k")).alias("mean_rate"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(g, "bin", "left").na.fill(0, ["n"]).withColumn("gap", F.col("mean_probability") - F.col("mean_rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(n, ece)."""
    return bins.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.abs("gap")), F.sum("n")).alias("ece"))


def bin_faults(bins: DataFrame, rows: DataFrame, stored_ece: float | None = None, count: int = 10, tolerance: float = 1e-14) -> DataFrame:
    """(rule, ok): the bins are 0..count-1, hold all rows, and reproduce the stored error within `tolerance`."""
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    g = bins.agg(F.count_distinct("bin").alias("bins"), F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("n").alias("n")).crossJoin(total).crossJoin(calibration_error(bins).select("ece"))  # one row each
    rules = [("partition", (F.col("bins") == count) & (F.col("lo") == 0) & (F.col("hi") == count - 1)), ("total", F.col("n") == F.col("rows"))]
    if stored_ece is not None:
        rules.append(("error", F.abs(F.col("ece") - stored_ece) <= tolerance))
    return g.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("ok")) for r, c in rules])).alias("x")).select("x.*")


def count_nll(df: DataFrame, k: int = 5) -> DataFrame:
    """Mean -ln pmf[c]; null, with a note, unless every row has k trials and a positive mass."""
    mass = F.element_at("pmf", F.col("correct_count").cast("int") + 1)
    fit, positive = F.bool_and(F.coalesce((F.col("k") == k) & (F.size("pmf") == k + 1), F.lit(False))), F.bool_and(F.coalesce(mass > 0, F.lit(False)))
    value = F.avg(F.when(mass > 0, -F.ln(mass)))
    note = F.when(~fit, f"not all rows have k = {k}").when(~positive, "zero mass")
    return df.agg(F.count(F.lit(1)).alias("n"), F.when(fit & positive, value).alias("count_nll"), note.alias("note"))


def ranked_probability_score(df: DataFrame, group: list[str] = (), k: int = 5) -> DataFrame:
    """Mean over rows and the k cut points of (CDF - [c <= j])^2 of the array `pmf`."""
    cdf = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.aggregate(F.slice("pmf", 1, j), F.lit(0.0), lambda a, x: a + x))
    sq = F.transform(cdf, lambda v, j: F.pow(v - F.when(F.col("correct_count") <= j, 1.0).otherwise(0.0), F.lit(2)))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.aggregate(sq, F.lit(0.0), lambda a, x: a + x) / k).alias("rps"))


def six_levels(df: DataFrame, group: list[str] = ()) -> DataFrame:
    """M15."""
    lv = df.select(*group, truth_level(F.col("correct_count"), F.col("k")).alias("truth"), probability_level(F.col("probability")).alias("said"))
    return pair_descriptors(lv, "truth", "said", group)


def bundle(df: DataFrame, group: list[str]) -> DataFrame:
    """Likelihoods, routing and rank correlation of each group, with a reason for each undefined value."""
    s = df.withColumn("_rate", F.col("correct_count") / F.col("k"))
    j = likelihoods(df, group).join(routing(df, group), group).join(spearman(s, "probability", "_rate", group).drop("n"), group)
    return j.withColumns({"spearman_reason": F.when(F.col("spearman").isNull(), "constant values"), "log_loss_reason": F.when(F.col("log_loss").isNull(), "infinite loss"),
                          "macro_f1_reason": F.when(F.col("macro_f1").isNull(), "one class only")})


def category_baseline(development: DataFrame, evaluation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluation rows with the development mean rate of their category as probability, categories without any)."""
    m = development.groupBy("category").agg(F.avg(F.col("correct_count") / F.col("k")).alias("probability"))
    e = evaluation.drop("probability")
    return e.join(m, "category"), e.select("category").distinct().join(m, "category", "left_anti")


def policies(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row per (row, policy) with the policy's probability; group by `policy` (and a view) afterwards."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), c.cast("double").alias("p")) for n, c in named.items()])).alias("x")
    keep = [c for c in df.columns if c != "probability"]
    return df.select(*keep, each).select(*keep, "x.policy", F.col("x.p").alias("probability"))


def contrasts(metrics: DataFrame, left: str, right: str, names: list[str], key: str = "view", cell: str = "policy") -> DataFrame:
    """(key, metric, difference) of two cells' metrics; null if either is null."""
    long = metrics.select(key, cell, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([key, cell], names, "metric", "value")
    a, b = long.where(F.col(cell) == left).select(key, "metric", F.col("value").alias("l")), long.where(F.col(cell) == right).select(key, "metric", F.col("value").alias("r"))
    return a.join(b, [key, "metric"]).select(key, "metric", (F.col("l") - F.col("r")).alias("difference"))


def numeric_summary(df: DataFrame, value: str, group: list[str] = ()) -> DataFrame:
    """N, missing, mean, SD, quartiles, least and greatest, rounded half to even to one place."""
    base = df.groupBy(*group).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.bround(F.avg(value), 1).alias("mean"), F.bround(F.stddev_samp(value), 1).alias("sd"),
                                  F.bround(F.min(value), 1).alias("least"), F.bround(F.max(value), 1).alias("greatest"))
    q = with_quantiles(base, df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)
    return q.select(*group, "n", "missing", "mean", "sd", *[F.bround(c, 1).alias(c) for c in ("q1", "median", "q3")], "least", "greatest")


def category_summary(df: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """(category, n, percent) for all listed categories, absent ones with 0."""
    grid = df.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    g = df.groupBy(F.col(value).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(g, "category", "left").na.fill(0, ["n"]).crossJoin(total).select("category", "n", F.bround(100 * F.try_divide("n", "_t"), 1).alias("percent"))  # one row of total


def timing(ratings: DataFrame, rater: str = "rater", ms: str = "response_time_ms") -> DataFrame:
    """Median seconds per item and median of the raters' total seconds."""
    item = with_quantiles(ratings.agg(F.count(ms).alias("n")), ratings, ms, {"_m": 0.5}).select((F.col("_m") / 1000).alias("item_seconds"), "n")
    sums = ratings.groupBy(rater).agg(F.sum(ms).alias("s"))
    whole = with_quantiles(sums.agg(F.count(F.lit(1)).alias("raters")), sums, "s", {"_w": 0.5}).select((F.col("_w") / 1000).alias("rater_seconds"), "raters")
    return item.crossJoin(whole)  # one row each


def corpus_counts(full: DataFrame, retained: DataFrame, key: str = "question_id") -> DataFrame:
    """(part, level, n, mean_rate) of full, retained and dropped items; every level appears."""
    lv = full.select(key, truth_level(F.col("correct_count"), F.col("k")).alias("level"), (F.col("correct_count") / F.col("k")).alias("rate"))
    mark = lv.join(retained.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    part = F.explode(F.array(F.lit("full"), F.when(F.col("_in"), "retained").otherwise("dropped"))).alias("part")
    g = mark.select("level", "rate", part).groupBy("part", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("rate").alias("mean_rate"))
    grid = full.sparkSession.range(6).select(F.col("id").cast("int").alias("level")).crossJoin(full.sparkSession.createDataFrame([("full",), ("retained",), ("dropped",)], "part string"))
    return grid.join(g, ["part", "level"], "left").na.fill(0, ["n"])


def level_shares(df: DataFrame) -> DataFrame:
    """(level, n, share) of the six truth levels."""
    g = df.groupBy(truth_level(F.col("correct_count"), F.col("k")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(6).select(F.col("id").cast("int").alias("level"))
    j = grid.join(g, "level", "left").na.fill(0, ["n"])
    return j.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(F.lit(1)))))  # six rows


def best_epochs(df: DataFrame, fit: str = "fit", epoch: str = "epoch", score: str = "score") -> DataFrame:
    """Per fit the earliest epoch with the least score."""
    return df.groupBy(fit).agg(F.min(F.struct(score, epoch)).alias("b")).select(fit, F.col(f"b.{epoch}").alias(epoch), F.col(f"b.{score}").alias(score))


BANDS = [(0.0, 0.1), (0.1, 0.3), (0.3, 0.7), (0.7, 0.9), (0.9, 1.0)]


def band_mass(df: DataFrame, rate: str, weight: str, bands: list[tuple[float, float]] = BANDS) -> DataFrame:
    """Share of the weight in each band, both ends counted."""
    grid = df.sparkSession.createDataFrame(bands, "low double, high double")
    total = df.agg(F.sum(weight).alias("_t"))
    j = df.join(F.broadcast(grid), F.col(rate).between(F.col("low"), F.col("high"))).groupBy("low", "high").agg(F.sum(weight).alias("w"))
    return F.broadcast(grid).join(j, ["low", "high"], "left").crossJoin(total).select("low", "high", F.coalesce(F.try_divide("w", "_t"), F.lit(0.0)).alias("mass"))  # one row of total
