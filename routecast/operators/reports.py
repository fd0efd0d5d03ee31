"""Whole reports: panel agreement, judge calibration, audits, policy tables, demographics, conversion and annotation forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routecast.functions import expr as X
from routecast.operators import scoring
from routecast.operators.agreement import confusion, fleiss, scotts_pi, stratified_error
from routecast.operators.panel import majority
from routecast.operators.sampling import packages


def panel_agreement(verdicts: DataFrame, panel: DataFrame) -> DataFrame:
    """One row of both Fleiss' kappas and the unanimous share of a whole panel, to four places, and its size."""
    v = verdicts.join(panel, "key", "left_semi").withColumn("binary", F.col("verdict") == "match")
    three, two = fleiss(v, "key", "verdict"), fleiss(v, "key", "binary")
    share = panel.agg(F.avg(F.col("unanimous").cast("double")).alias("_u"), F.count(F.lit(1)).alias("n"))
    j = three.select(F.bround("kappa", 4).alias("fleiss_kappa_three_way")).crossJoin(two.select(F.bround("kappa", 4).alias("fleiss_kappa_binary"))).crossJoin(share)  # one row each
    return j.select("fleiss_kappa_three_way", "fleiss_kappa_binary", F.bround("_u", 4).alias("unanimous_share"), "n")


def three_way(verdicts: DataFrame, human: DataFrame) -> DataFrame:
    """(judge, human, said, n) of the verdicts of judges against human ones, `human` (key, verdict); items without one are left out."""
    h = human.where(F.col("verdict").isNotNull()).select("key", F.col("verdict").alias("human"))
    return verdicts.select("key", "judge", F.col("verdict").alias("said")).join(h, "key").groupBy("judge", "human", "said").agg(F.count(F.lit(1)).alias("n"))


def calibration(verdicts: DataFrame, human: DataFrame, judge_gate: float = 0.8, panel_gate: float = 0.8, judges: int = 3) -> DataFrame:
    """A row per judge and one for the panel (`judge` null) with pi, the 2x2 counts and the reason it fails, null if it passes.

    `human` (key, match). Only keys of all `judges` count; the panel says match with two such verdicts. A judge is lenient with 8 or more
    false matches that exceed twice the human ratio of others to matches times the false refusals (at least 1).
    """
    whole = verdicts.groupBy("key").agg(F.count_distinct("judge").alias("_j"), (F.count_if(F.col("verdict") == "match") >= 2).alias("said")).where(F.col("_j") == judges)
    h = human.select("key", F.col("match").alias("truth"))
    own = verdicts.join(whole.select("key"), "key").select("key", "judge", (F.col("verdict") == "match").alias("said"))
    rows = own.unionByName(whole.select("key", F.lit(None).cast("string").alias("judge"), "said")).join(h, "key").withColumn("judge", F.coalesce("judge", F.lit("")))
    pi = scotts_pi(rows, F.col("truth"), F.col("said"), ["judge"]).select("judge", "n", "pi")
    c = confusion(rows, F.col("truth"), F.col("said"), ["judge"]).select("judge", "tn", "fp", "fn", "tp")
    matches, others = F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp")  # the human side is the same in every row
    ratio = F.coalesce(F.try_divide(others, matches), F.lit(1.0))
    lenient = (F.col("judge") != "") & (F.col("fp") >= 8) & (F.col("fp") > 2 * ratio * F.greatest(F.col("fn"), F.lit(1)))
    gate = F.when(F.col("judge") == "", panel_gate).otherwise(judge_gate)
    reason = F.nullif(F.concat_ws(",", F.when(F.col("pi") < gate, "below gate"), F.when(lenient, "lenient")), F.lit(""))
    return pi.join(c, "judge").select(F.nullif("judge", F.lit("")).alias("judge"), "n", "pi", "tn", "fp", "fn", "tp", reason.alias("reason"))


def stratified_agreement(votes: DataFrame, decisions: DataFrame, populations: DataFrame) -> DataFrame:
    """`stratified_error` with the agreement of each stratum, and the items and Fleiss' kappa of all votes in every row."""
    k = fleiss(votes.join(decisions.select("item"), "item", "left_semi"), "item", "vote", uneven=True).select(F.col("items"), F.col("kappa").alias("fleiss_kappa"))
    e = stratified_error(votes, decisions, populations).withColumn("agreement", F.try_divide("agree", "scored"))
    return e.crossJoin(F.broadcast(k))  # one row


def _judged(votes: DataFrame, fields: list[str]) -> DataFrame:
    """(field, stratum, item, ok): the majority of each field's votes."""
    return votes.unpivot(["item", "stratum"], fields, "field", "vote").groupBy("field", "stratum", "item").agg(majority(F.col("vote")).alias("ok"))


def field_report(votes: DataFrame, populations: DataFrame, fields: list[str]) -> DataFrame:
    """Per field items, splits, errors, population-weighted error over strata with scored items, Fleiss' kappa and decision."""
    g = _judged(votes, fields).groupBy("field", "stratum").agg(F.count(F.lit(1)).alias("items"), F.count("ok").alias("scored"), F.count_if(~F.col("ok")).alias("wrong"))
    used = F.when(F.col("scored") > 0, F.col("population"))
    w = g.join(populations, "stratum").groupBy("field").agg(F.sum("items").alias("items"), (F.sum("items") - F.sum("scored")).alias("splits"), F.sum("wrong").alias("wrong"),
                                                            (F.sum(used * F.try_divide("wrong", "scored")) / F.sum(used)).alias("error"))
    k = fleiss(votes.unpivot(["item", "stratum"], fields, "field", "vote"), "item", "vote", ["field"], uneven=True).select("field", F.col("kappa").alias("fleiss_kappa"))
    return w.join(k, "field").withColumn("decision", F.when(F.col("error") <= 0.05, "pass").when(F.col("error") <= 0.10, "repair").otherwise("revise"))


def field_failures(votes: DataFrame, fields: list[str]) -> DataFrame:
    """(field, item) of the items whose majority rejects the field."""
    return _judged(votes, fields).where("not ok").select("field", "item")


POLICY_METRICS = ["kappa", "accuracy", "fpr", "fnr", "log_loss", "rmse"]


def policy_table(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Per view and policy, and for the view `combined` of all rows, level, routing and probability metrics.

    `df` has view, correct_count, k and what the policies' columns need.
    """
    views = df.select("*", F.explode(F.array("view", F.lit("combined"))).alias("_v")).drop("view").withColumnRenamed("_v", "view")
    p, by = scoring.policies(views, named), ["view", "policy"]
    level = scoring.six_levels(p, by).select(*by, "kappa", "bias", F.col("mae").alias("mae_levels"))
    rates = scoring.routing(p, by).select(*by, "accuracy", "fpr", "fnr")
    return scoring.likelihoods(p, by).select(*by, "n", "log_loss", "rmse", "brier", "mae").join(level, by).join(rates, by)


def policy_differences(table: DataFrame, left: str, right: str) -> DataFrame:
    """(view, metric, difference) of two policies in the six compared metrics; null if either is."""
    return scoring.contrasts(table, left, right, POLICY_METRICS)


def background_report(answers: DataFrame) -> DataFrame:
    """M24 of free answers (field, raw), ages and categories alike: (field, status, n) after coding, and for coded answers the mean, SD, quartiles, least and greatest code or age."""
    coded = X.coded_background(answers)
    n = coded.groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))
    numbers = scoring.numeric_summary(coded.where("status = 'coded'"), "value", ["field"]).drop("n", "missing").withColumn("status", F.lit("coded"))
    return n.join(numbers, ["field", "status"], "left")


def category_report(df: DataFrame, value: str, categories: dict[str, str]) -> DataFrame:
    """(category, n, denominator, percent): the listed categories among valid answers, ambiguous and missing ones among all.

    `categories` maps trimmed lower-case answers to categories; null or blank is `not reported`, any other answer `ambiguous`.
    """
    answer = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    names = reduce(lambda c, kv: c.when(answer == kv[0], kv[1]), categories.items(), F.when(answer == "", "not reported")).otherwise("ambiguous")
    g = df.groupBy(names.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    listed = list(dict.fromkeys(categories.values()))
    grid = df.sparkSession.createDataFrame([(c, c in listed) for c in [*listed, "ambiguous", "not reported"]], "category string, valid boolean")
    j = F.broadcast(grid).join(g, "category", "left").na.fill(0, ["n"])
    total = j.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("valid"), F.col("n"))).alias("_valid"))
    out = j.crossJoin(total).withColumn("denominator", F.when(F.col("valid"), F.col("_valid")).otherwise(F.col("_all")))  # one row
    return out.select("category", "n", "denominator", F.bround(100 * F.try_divide("n", "denominator"), 1).alias("percent"))


def conversion_report(df: DataFrame) -> DataFrame:
    """One row of decided and failed records, rate, readmissions, tokens, dangling, leaking, empty and failed rewrites.

    `df`: error, convertible, stage, tokens (struct of in, out), question, open_question, reference_answer. Empty rewrites of convertible records
    are counted in `empty`; `checks` of the caller decide whether any is an error.
    """
    done = ~F.col("error")
    kept = done & F.col("convertible")
    again = done & (F.col("stage") == "rescore")
    counted = done & F.col("tokens").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(counted, F.col(c).cast("long"))), F.lit(0))
    g = df.agg(F.count_if(done).alias("decided"), F.count_if("error").alias("failed"), F.count_if(kept).alias("convertible"), F.count_if(again).alias("rescored"), F.count_if(again & F.col("convertible")).alias("readmitted"),
               total("tokens.in").alias("tokens_in"), total("tokens.out").alias("tokens_out"), F.count_if(counted).alias("counted"), F.count_if(kept & _stuck()).alias("dangling"), F.count_if(kept & _leaks()).alias("answer_leaks"),
               F.count_if(kept & (F.trim("open_question") == "")).alias("empty"), F.count_if(done & (F.col("stage") == "rewrite_error")).alias("rewrite_errors"))
    return g.withColumns({"rate": F.try_divide("convertible", "decided"), "readmission_rate": F.try_divide("readmitted", "rescored")})


def _stuck() -> Column:
    return X.dangling(F.col("open_question"))


def _leaks() -> Column:
    return X.leaks(F.col("reference_answer"), F.col("open_question"), F.col("question"))


def failure_modes(df: DataFrame) -> DataFrame:
    """(failure, n) of decided records, most frequent first."""
    return df.where("not error and failure <> ''").groupBy("failure").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "failure")


def audit_first(df: DataFrame, most: int = 10) -> DataFrame:
    """(fault, question_id): the first `most` convertible records by id that are dangling, and those that leak (a top-k report)."""
    kept = df.where("not error and convertible")
    top = lambda cond, name: kept.where(cond).select(F.lit(name).alias("fault"), "question_id").orderBy("question_id").limit(most)
    return top(_stuck(), "dangling").unionByName(top(_leaks(), "leak"))


def annotation_forms(items: DataFrame, annotators: list[str], seed: int, key: str, blanks: list[str]) -> DataFrame:
    """The packages of the annotators with empty form columns."""
    return packages(items, annotators, seed, key).withColumns({b: F.lit("") for b in blanks})
