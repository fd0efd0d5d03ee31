"""Queries of labels, judge panels and cohorts (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.operators import agreement as A
from routecast.operators import panel as P
from routecast.plans.views import corpus, items, majority_sql, over, ratings, read, split, trials, v_labels, verdicts
from routecast.registry import query

PANEL = """, p AS (SELECT key, count(*) AS n, count(*) FILTER (verdict = 'match') AS n_match, count(*) FILTER (verdict = 'no_match') AS n_no_match, count(*) FILTER (verdict = 'no_answer') AS n_no_answer, min(verdict) = max(verdict) AS unanimous FROM verdicts GROUP BY 1 HAVING count(*) = 3)"""


@query("with_reference", over("trials items", "SELECT question_id, rep, success, category FROM trials JOIN items USING (question_id)"))
def with_reference(spark: SparkSession, d: str) -> DataFrame:
    found, _ = P.with_reference(trials(spark, d), items(spark, d).select("question_id", "category"))
    return found.select("question_id", "rep", "success", "category")


@query("panel_verdicts", over("verdicts", PANEL + " SELECT key, n_match >= 2 AS correct, n_match, n_no_match, n_no_answer, unanimous FROM p"))
def panel_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return P.panel(verdicts(spark, d), one_each=True)[0]


@query("panel_incomplete", over("verdicts", "SELECT key, count(*) AS judges FROM verdicts GROUP BY 1 HAVING count(*) <> 3"))
def panel_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return P.panel(verdicts(spark, d), one_each=True)[1]


@query("panel_labels", over("verdicts items", PANEL + """ SELECT question_id, correct_count, no_answer_count, k, category, list_style FROM
(SELECT CAST(split_part(key, ':', 1) AS BIGINT) AS question_id, count(*) FILTER (n_match >= 2) AS correct_count, count(*) FILTER (n_no_answer > 0) AS no_answer_count, count(*) AS k FROM p GROUP BY 1) LEFT JOIN items USING (question_id)"""))
def panel_labels(spark: SparkSession, d: str) -> DataFrame:
    return P.panel_labels(P.panel(verdicts(spark, d), one_each=True)[0], items(spark, d).select("question_id", "category", "list_style"))


@query("panel_fleiss", over("verdicts", PANEL + """, v AS (SELECT * FROM verdicts JOIN p USING (key)), i AS (SELECT key, verdict, count(*) AS n FROM v GROUP BY 1, 2),
o AS (SELECT avg(s) AS o, count(*) AS items FROM (SELECT (sum(n * n) - 3) / 6e0 AS s FROM i GROUP BY key)), e AS (SELECT sum(c * c / (t * t)) AS e FROM (SELECT sum(n) * 1e0 AS c, sum(sum(n)) OVER () * 1e0 AS t FROM i GROUP BY verdict))
SELECT items, (o - e) / (1 - e) AS kappa, (SELECT avg(CASE WHEN unanimous THEN 1e0 ELSE 0e0 END) FROM p) AS unanimous FROM o, e"""))
def panel_fleiss(spark: SparkSession, d: str) -> DataFrame:
    """J5 with A4 on the three-way verdict."""
    v = verdicts(spark, d)
    done = P.panel(v, one_each=True)[0]
    f = A.fleiss(v.join(done, "key", "left_semi"), "key", "verdict")
    return f.select("items", "kappa").crossJoin(done.agg(F.avg(F.col("unanimous").cast("double")).alias("unanimous")))  # one row each


@query("panel_complete", over("verdicts items", PANEL + """, l AS (SELECT CAST(split_part(key, ':', 1) AS BIGINT) AS question_id, count(*) AS k FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM l) AS questions, (SELECT count(*) FROM l WHERE k <> 5) AS wrong_k, (SELECT count(*) FROM items) AS expected,
  (SELECT count(*) FROM l) = (SELECT count(*) FROM items) AND (SELECT count(*) FROM l WHERE k <> 5) = 0 AS complete"""))
def panel_complete(spark: SparkSession, d: str) -> DataFrame:
    l = P.panel_labels(P.panel(verdicts(spark, d), one_each=True)[0], items(spark, d).select("question_id", "category"))
    return P.completeness(l, items(spark, d).withColumn("convertible", F.lit(True)), 5)


@query("majority_votes", f"SELECT item, {majority_sql('vote')} AS majority FROM (SELECT l_partkey AS item, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'borderline' END AS vote FROM lineitem) GROUP BY 1")
def majority_votes(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem")
    vote = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("borderline")
    return t.select(F.col("l_partkey").alias("item"), vote.alias("vote")).groupBy("item").agg(P.majority(F.col("vote")).alias("majority"))


@query("human_consensus", over("verdicts", """, n AS (SELECT key, verdict, count(*) AS n FROM verdicts GROUP BY 1, 2)
SELECT key, coalesce(sum(n) FILTER (verdict = 'match'), 0) >= 2 AS match, CASE WHEN max(n) >= 2 THEN max(verdict) FILTER (n >= 2) END AS verdict FROM n GROUP BY 1"""))
def human_consensus(spark: SparkSession, d: str) -> DataFrame:
    return P.consensus(verdicts(spark, d))


@query("prompt_ratings", over("ratings", "SELECT prompt, CAST(quantile_disc(rating_level, 0.5) AS INT) AS median_level, 2 * count(*) FILTER (rating_level >= 3) > count(*) AS local, true AS agrees FROM ratings GROUP BY 1"))
def prompt_ratings(spark: SparkSession, d: str) -> DataFrame:
    return P.prompt_ratings(ratings(spark, d), raters=None)


@query("cohorts", over("items v_labels split", """
SELECT question_id, category, correct_count, invalid_count, k, CASE WHEN question_id % 20 = 0 THEN 'study' ELSE 'remainder' END AS cohort FROM items JOIN v_labels USING (question_id) JOIN split USING (question_id) WHERE split = 'test'"""))
def cohorts(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return P.cohorts(i.withColumn("convertible", F.lit(True)), v_labels(spark, d), split(spark, d), i.where("question_id % 20 = 0"))


@query("corpus_strata", over("corpus", "SELECT stage, convertible, count(*) AS n FROM corpus GROUP BY 1, 2"))
def corpus_strata(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).groupBy("stage", "convertible").agg(F.count(F.lit(1)).alias("n"))
