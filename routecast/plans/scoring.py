"""Queries of forecast scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.functions import expr as X
from routecast.operators import scoring as M
from routecast.plans.agreement import RATES
from routecast.plans.views import forecasts, items, over, participants, ratings, read, split, v_labels
from routecast.registry import query

CLIPPED = "greatest(least({p}, 1 - 1e-9), 1e-9)"


def _nll(p: str) -> str:
    q = CLIPPED.format(p=p)
    return f"-(correct_count * ln({q}) + (k - correct_count) * ln(1 - {q}))"


LOSS = "-(CASE WHEN correct_count = 0 THEN 0e0 WHEN probability > 0 THEN correct_count / CAST(k AS DOUBLE) * ln(probability) END + CASE WHEN correct_count = k THEN 0e0 WHEN probability < 1 THEN (1 - correct_count / CAST(k AS DOUBLE)) * ln(1 - probability) END)"
LIKE = f"""count(*) AS n, avg({_nll('probability')}) AS nll, 2 * (avg({_nll('probability')}) - avg({_nll('correct_count / CAST(k AS DOUBLE)')})) AS deviance,
avg(sqrt(correct_count / CAST(k AS DOUBLE) * (1 - correct_count / CAST(k AS DOUBLE)) / k)) AS noise_floor, avg(abs(probability - correct_count / CAST(k AS DOUBLE))) AS mae,
avg(pow(probability - correct_count / CAST(k AS DOUBLE), 2)) AS brier, CASE WHEN count(*) = count({LOSS}) THEN avg({LOSS}) END AS log_loss, sqrt(avg(pow(probability - correct_count / CAST(k AS DOUBLE), 2))) AS rmse"""
TABLE = "count(*) FILTER (NOT t AND NOT s) AS tn, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (t AND s) AS tp"
F1 = "CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) + coalesce(2 * tn / CAST(nullif(2 * tn + fp + fn, 0) AS DOUBLE), 0)) / 2 END AS macro_f1"


@query("nll_brier_mae", over("forecasts", f"SELECT category, {LIKE} FROM forecasts GROUP BY 1"))
def nll_brier_mae(spark: SparkSession, d: str) -> DataFrame:
    return M.likelihoods(forecasts(spark, d), ["category"])


RANKS = """, r AS (SELECT category, probability AS x, correct_count / CAST(k AS DOUBLE) AS y FROM forecasts), a AS (SELECT category, rank() OVER (PARTITION BY category ORDER BY x) + (count(*) OVER (PARTITION BY category, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY category ORDER BY y) + (count(*) OVER (PARTITION BY category, y) - 1) / 2e0 AS ry FROM r)"""


@query("spearman", over("forecasts", RANKS + " SELECT category, count(*) AS n, corr(rx, ry) AS spearman FROM a GROUP BY 1"))
def spearman(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).withColumn("rate", F.col("correct_count") / F.col("k"))
    return M.spearman(f, "probability", "rate", ["category"])


@query("routing", over("forecasts", f", c AS (SELECT category, {TABLE} FROM (SELECT category, correct_count / CAST(k AS DOUBLE) >= 0.5e0 AS t, probability >= 0.5e0 AS s FROM forecasts) GROUP BY 1) SELECT *, {RATES}, {F1} FROM c"))
def routing(spark: SparkSession, d: str) -> DataFrame:
    return M.routing(forecasts(spark, d), ["category"])


SWEEP = f""", f AS (SELECT probability AS p, 2 * correct_count >= k AS t FROM forecasts), h AS (SELECT p AS threshold FROM f UNION SELECT unnest([0e0, 0.5e0, 0.7e0, 1e0])),
c AS (SELECT threshold, count(*) FILTER (NOT t AND p < threshold) AS tn, count(*) FILTER (NOT t AND p >= threshold) AS fp, count(*) FILTER (t AND p < threshold) AS fn, count(*) FILTER (t AND p >= threshold) AS tp FROM h, f GROUP BY 1), w AS (SELECT *, {RATES} FROM c)"""


@query("threshold_sweep", over("forecasts", SWEEP + " SELECT * FROM w"))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return M.full_sweep(forecasts(spark, d))


@query("operating_points", over("forecasts", SWEEP + " SELECT * FROM w WHERE fpr <= 0.4e0 AND fnr <= 0.7e0"))
def operating_points(spark: SparkSession, d: str) -> DataFrame:
    return M.operating_points(M.full_sweep(forecasts(spark, d)), 0.4, 0.7)


@query("fixed_sweep", over("forecasts", f", h AS (SELECT unnest(range(19)) * 0.05e0 + 0.05e0 AS h), c AS (SELECT round(h, 3) AS threshold, {TABLE} FROM (SELECT h, correct_count / CAST(k AS DOUBLE) >= 0.5e0 AS t, probability >= h AS s FROM h, forecasts) GROUP BY 1) SELECT *, {RATES}, {F1} FROM c"))
def fixed_sweep(spark: SparkSession, d: str) -> DataFrame:
    return M.fixed_sweep(forecasts(spark, d))


BINS = ", b AS (SELECT CAST(unnest(range(10)) AS INT) AS bin), g AS (SELECT CAST(least(floor(probability * 10), 9) AS INT) AS bin, probability AS p, correct_count / CAST(k AS DOUBLE) AS r FROM forecasts), q AS (SELECT b.bin, count(p) AS n, avg(p) AS mean_probability, avg(r) AS mean_rate, avg(p) - avg(r) AS gap FROM b LEFT JOIN g ON b.bin = g.bin GROUP BY 1)"


@query("reliability_bins", over("forecasts", BINS + " SELECT * FROM q"))
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return M.reliability_bins(forecasts(spark, d))


@query("calibration_error", over("forecasts", BINS + " SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * abs(gap)) / sum(n) AS ece FROM q"))
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return M.calibration_error(M.reliability_bins(forecasts(spark, d)))


@query("bin_faults", over("forecasts", """, b AS (SELECT least(floor(probability * 10), 9) AS bin, count(*) AS n, abs(avg(probability) - avg(correct_count / CAST(k AS DOUBLE))) AS gap FROM forecasts GROUP BY 1),
g AS (SELECT 'whole' AS bins, 10 AS wanted, * FROM b UNION ALL SELECT 'part', 9, * FROM b WHERE bin < 9), e AS (SELECT bins, any_value(wanted) = 10 AS whole, sum(n) AS n, sum(n * gap) / sum(n) AS ece FROM g GROUP BY 1)
SELECT bins, unnest(['partition', 'total', 'error']) AS rule, unnest([whole, n = (SELECT count(*) FROM forecasts), ece <= 0.2e0]) AS ok FROM e"""))
def bin_faults(spark: SparkSession, d: str) -> DataFrame:
    """All bins of the forecasts, and all but the last, held against the rows and a stored error."""
    f = forecasts(spark, d)
    bins = M.reliability_bins(f)
    return M.bin_faults(bins, f, 0.1, tolerance=0.1).select(F.lit("whole").alias("bins"), "rule", "ok").unionByName(M.bin_faults(bins.where("bin < 9"), f, 0.1, tolerance=0.1).select(F.lit("part").alias("bins"), "rule", "ok"))


PMF = "[pow(1 - q, 5), 5 * q * pow(1 - q, 4), 10 * q * q * pow(1 - q, 3), 10 * pow(q, 3) * pow(1 - q, 2), 5 * pow(q, 4) * (1 - q), pow(q, 5)]"
FIVE = f", z AS (SELECT category, question_id % 6 AS c, greatest(least(probability, 0.999e0), 0.001e0) AS q FROM forecasts), y AS (SELECT category, c, {PMF} AS pmf FROM z)"


def _five(spark: SparkSession, d: str) -> DataFrame:
    """Five-trial counts made from ids with the binomial head's distribution."""
    p = F.greatest(F.least(F.col("probability"), F.lit(0.999)), F.lit(0.001))
    f = forecasts(spark, d).select("category", (F.col("question_id") % 6).alias("correct_count"), F.lit(5).alias("k"), F.array(F.ln(p / (1 - p))).alias("logits"))
    return f.withColumn("pmf", X.decoded(F.col("logits"), "binomial")[1])


@query("count_nll", over("forecasts", FIVE + " SELECT count(*) AS n, avg(-ln(pmf[c + 1])) AS count_nll, CAST(NULL AS VARCHAR) AS note FROM y"))
def count_nll(spark: SparkSession, d: str) -> DataFrame:
    return M.count_nll(_five(spark, d))


@query("rps", over("forecasts", FIVE + " SELECT category, count(*) AS n, avg(list_sum(list_transform(range(5), lambda j: pow(list_sum(pmf[1:j + 1]) - CASE WHEN c <= j THEN 1e0 ELSE 0e0 END, 2))) / 5) AS rps FROM y GROUP BY 1"))
def rps(spark: SparkSession, d: str) -> DataFrame:
    return M.ranked_probability_score(_five(spark, d), ["category"])


@query("six_level_bias", over("forecasts", "SELECT category, avg(b - a) AS bias, avg(abs(b - a)) AS mae FROM (SELECT category, least(6 * correct_count // k, 5) AS a, least(floor(probability * 6), 5) AS b FROM forecasts) GROUP BY 1"))
def six_level_bias(spark: SparkSession, d: str) -> DataFrame:
    """M15."""
    return M.six_levels(forecasts(spark, d), ["category"]).select("category", "bias", "mae")


@query("metric_bundle", over("forecasts", RANKS + f""", s AS (SELECT category, corr(rx, ry) AS spearman FROM a GROUP BY 1), c AS (SELECT category, {TABLE} FROM (SELECT category, correct_count / CAST(k AS DOUBLE) >= 0.5e0 AS t, probability >= 0.5e0 AS s FROM forecasts) GROUP BY 1), e AS (SELECT *, {F1} FROM c), l AS (SELECT category, {LIKE} FROM forecasts GROUP BY 1)
SELECT category, n, nll, brier, log_loss, accuracy, macro_f1, spearman, CASE WHEN spearman IS NULL THEN 'constant values' END AS spearman_reason, CASE WHEN log_loss IS NULL THEN 'infinite loss' END AS log_loss_reason FROM l JOIN (SELECT *, {RATES} FROM e) USING (category) JOIN s USING (category)"""))
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    """M16."""
    return M.bundle(forecasts(spark, d), ["category"]).select("category", "n", "nll", "brier", "log_loss", "accuracy", "macro_f1", "spearman", "spearman_reason", "log_loss_reason")


VIEWS = ", m AS (SELECT category, avg(correct_count / CAST(k AS DOUBLE)) AS mean_rate FROM forecasts JOIN split USING (question_id) WHERE split = 'train' GROUP BY 1)"


@query("category_baseline", over("forecasts split", VIEWS + " SELECT question_id, category, mean_rate AS probability FROM forecasts JOIN split USING (question_id) JOIN m USING (category) WHERE split = 'test'"))
def category_baseline(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).join(split(spark, d), "question_id")
    return M.category_baseline(f.where("split = 'train'"), f.where("split = 'test'"))[0].select("question_id", "category", "probability")


POLICIES = f"""{VIEWS}, p AS (SELECT CASE WHEN question_id % 20 = 0 THEN 'study' ELSE 'remainder' END AS view, correct_count, k, unnest([{{'policy': 'classifier', 'p': probability}}, {{'policy': 'cloud', 'p': 0e0}}, {{'policy': 'category', 'p': mean_rate}}]) AS u FROM forecasts JOIN split USING (question_id) JOIN m USING (category) WHERE split = 'test'),
q AS (SELECT view, u.policy AS policy, avg(pow(u.p - correct_count / CAST(k AS DOUBLE), 2)) AS brier, avg(abs(u.p - correct_count / CAST(k AS DOUBLE))) AS mae, count(*) AS n FROM p GROUP BY 1, 2)"""


def _policies(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).join(split(spark, d), "question_id")
    m = f.where("split = 'train'").groupBy("category").agg(F.avg(F.col("correct_count") / F.col("k")).alias("mean_rate"))
    t = f.where("split = 'test'").join(m, "category").withColumn("view", F.when(F.col("question_id") % 20 == 0, "study").otherwise("remainder"))
    return M.likelihoods(M.policies(t, {"classifier": F.col("probability"), "cloud": F.lit(0.0), "category": F.col("mean_rate")}), ["view", "policy"])


@query("policy_metrics", over("forecasts split", POLICIES + " SELECT view, policy, n, brier, mae FROM q"))
def policy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M18, M19."""
    return _policies(spark, d).select("view", "policy", "n", "brier", "mae")


@query("policy_contrasts", over("forecasts split", POLICIES + " SELECT view, metric, difference FROM (SELECT a.view, unnest([{'metric': 'brier', 'difference': a.brier - b.brier}, {'metric': 'mae', 'difference': a.mae - b.mae}], recursive := true) FROM q a JOIN q b USING (view) WHERE a.policy = 'classifier' AND b.policy = 'cloud')"))
def policy_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return M.contrasts(_policies(spark, d), "classifier", "cloud", ["brier", "mae"])


@query("demographics", over("participants", "SELECT segment, count(age) AS n, count(*) - count(age) AS missing, round_even(avg(age), 1) AS mean, round_even(stddev_samp(age), 1) AS sd, round_even(quantile_cont(CAST(age AS DOUBLE), 0.25), 1) AS q1, round_even(quantile_cont(CAST(age AS DOUBLE), 0.5), 1) AS median, round_even(quantile_cont(CAST(age AS DOUBLE), 0.75), 1) AS q3, CAST(min(age) AS DOUBLE) AS least, CAST(max(age) AS DOUBLE) AS greatest FROM participants GROUP BY 1"))
def demographics(spark: SparkSession, d: str) -> DataFrame:
    return M.numeric_summary(participants(spark, d).withColumn("age", F.col("age").cast("double")), "age", ["segment"])


@query("segment_shares", "SELECT s.category, count(c_custkey) AS n, round_even(100e0 * count(c_custkey) / (SELECT count(*) FROM customer), 1) AS percent FROM (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS category) s LEFT JOIN customer ON c_mktsegment = s.category GROUP BY 1")
def segment_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.category_summary(participants(spark, d), "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"])


@query("item_timing", over("ratings", "SELECT median(response_time_ms) / 1000 AS item_seconds, count(*) AS n, (SELECT median(s) / 1000 FROM (SELECT CAST(sum(response_time_ms) AS DOUBLE) AS s FROM ratings GROUP BY rater)) AS rater_seconds, (SELECT count(DISTINCT rater) FROM ratings) AS raters FROM ratings"))
def item_timing(spark: SparkSession, d: str) -> DataFrame:
    return M.timing(ratings(spark, d))


@query("corpus_counts", over("v_labels", """, l AS (SELECT question_id, CAST(least(6 * correct_count // k, 5) AS INT) AS level, correct_count / CAST(k AS DOUBLE) AS r, question_id % 4 > 0 AS kept FROM v_labels),
p AS (SELECT 'full' AS part, level, r FROM l UNION ALL SELECT CASE WHEN kept THEN 'retained' ELSE 'dropped' END, level, r FROM l), g AS (SELECT p.part, CAST(v AS INT) AS level FROM (SELECT unnest(['full', 'retained', 'dropped']) AS part) p, range(6) t(v))
SELECT g.part, g.level, count(r) AS n, avg(r) AS mean_rate FROM g LEFT JOIN p ON g.part = p.part AND g.level = p.level GROUP BY 1, 2"""))
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    l = v_labels(spark, d)
    return M.corpus_counts(l, l.where("question_id % 4 > 0"))


@query("level_shares", over("v_labels", "SELECT g.level, count(question_id) AS n, count(question_id) / CAST((SELECT count(*) FROM v_labels) AS DOUBLE) AS share FROM (SELECT CAST(unnest(range(6)) AS INT) AS level) g LEFT JOIN v_labels ON least(6 * correct_count // k, 5) = g.level GROUP BY 1"))
def level_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.level_shares(v_labels(spark, d))


@query("best_epochs", "SELECT l_suppkey AS fit, arg_min(l_linenumber, (l_tax, l_linenumber)) AS epoch, min(l_tax) AS score FROM lineitem GROUP BY 1")
def best_epochs(spark: SparkSession, d: str) -> DataFrame:
    return M.best_epochs(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("fit"), F.col("l_linenumber").alias("epoch"), F.col("l_tax").alias("score")))


@query("band_mass", over("v_labels", "SELECT low, high, coalesce(sum(k) FILTER (correct_count / CAST(k AS DOUBLE) BETWEEN low AND high), 0) / CAST(sum(k) AS DOUBLE) AS mass FROM (VALUES (0e0, 0.1e0), (0.1e0, 0.3e0), (0.3e0, 0.7e0), (0.7e0, 0.9e0), (0.9e0, 1e0)) b(low, high), v_labels GROUP BY 1, 2"))
def band_mass(spark: SparkSession, d: str) -> DataFrame:
    return M.band_mass(v_labels(spark, d).select((F.col("correct_count") / F.col("k")).alias("rate"), "k"), "rate", "k")


@query("success_model")
def success_model(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on train items, scored on test items; no SQL expresses it."""
    from routecast.operators import model

    f = items(spark, d).join(v_labels(spark, d), "question_id").join(split(spark, d), "question_id")
    return model.predict(model.fit(f.where("split = 'train'")), f.where("split = 'test'").select("question_id", "text")).select("question_id", "probability")
