"""Queries of the whole reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.operators import panel as P
from routecast.operators import reports as R
from routecast.plans.agreement import RATES, _kappa_sql
from routecast.plans.scoring import LIKE, TABLE, VIEWS
from routecast.plans.trials import PANEL
from routecast.plans.views import corpus, forecasts, items, majority_sql, over, ratings, read, split, verdicts
from routecast.registry import query


def _fleiss_sql(rows: str, value: str) -> str:
    """Fleiss' kappa of `rows` (key and `value`), two or more to a key that agreement is counted of."""
    return f"""(SELECT (o - e) / (1 - e) FROM (SELECT avg(s) AS o FROM (SELECT CASE WHEN sum(n) > 1 THEN (sum(n * n) - sum(n)) / CAST(sum(n) * (sum(n) - 1) AS DOUBLE) END AS s FROM (SELECT key, {value}, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY key)),
(SELECT sum(c * c / (t * t)) AS e FROM (SELECT count(*) * 1e0 AS c, sum(count(*)) OVER () * 1e0 AS t FROM {rows} GROUP BY {value})))"""


@query("panel_agreement", over("verdicts", PANEL + f""", v AS (SELECT key, verdict, verdict = 'match' AS b FROM verdicts JOIN p USING (key))
SELECT round_even({_fleiss_sql('v', 'verdict')}, 4) AS fleiss_kappa_three_way, round_even({_fleiss_sql('v', 'b')}, 4) AS fleiss_kappa_binary, round_even(avg(CASE WHEN unanimous THEN 1e0 ELSE 0e0 END), 4) AS unanimous_share, count(*) AS n FROM p"""))
def panel_agreement(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d)
    return R.panel_agreement(v, P.panel(v, one_each=True)[0])


HUMAN = ", human AS (SELECT l_partkey || ':' || l_linenumber AS key, max(CASE WHEN l_returnflag = 'N' THEN 'match' WHEN l_returnflag = 'R' THEN 'no_match' ELSE 'no_answer' END) AS verdict FROM lineitem GROUP BY 1)"


def _human(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem")
    v = F.when(F.col("l_returnflag") == "N", "match").when(F.col("l_returnflag") == "R", "no_match").otherwise("no_answer")
    return t.groupBy(F.concat_ws(":", "l_partkey", "l_linenumber").alias("key")).agg(F.max(v).alias("verdict"))


@query("judge_confusion", over("verdicts", HUMAN + " SELECT judge, human.verdict AS human, verdicts.verdict AS said, count(*) AS n FROM verdicts JOIN human USING (key) GROUP BY 1, 2, 3"))
def judge_confusion(spark: SparkSession, d: str) -> DataFrame:
    return R.three_way(verdicts(spark, d), _human(spark, d))


@query("judge_calibration", over("verdicts", PANEL + HUMAN + f""", j AS (SELECT judge, verdicts.verdict = 'match' AS s, human.verdict = 'match' AS t FROM verdicts JOIN p USING (key) JOIN human USING (key) UNION ALL SELECT NULL, n_match >= 2, verdict = 'match' FROM p JOIN human USING (key)),
g AS (SELECT judge, count(*) AS n, {TABLE} FROM j GROUP BY 1), y AS (SELECT *, (tn + tp) * 1e0 / n AS o, (2 * tp + fp + fn) / (2e0 * n) AS y FROM g), q AS (SELECT *, (o - (y * y + (1 - y) * (1 - y))) / (1 - (y * y + (1 - y) * (1 - y))) AS pi FROM y)
SELECT judge, n, pi, tn, fp, fn, tp, nullif(concat_ws(',', CASE WHEN pi < 0.8e0 THEN 'below gate' END, CASE WHEN judge IS NOT NULL AND fp >= 8 AND fp > 2 * coalesce((tn + fp) / CAST(nullif(fn + tp, 0) AS DOUBLE), 1e0) * greatest(fn, 1) THEN 'lenient' END), '') AS reason FROM q"""))
def judge_calibration(spark: SparkSession, d: str) -> DataFrame:
    return R.calibration(verdicts(spark, d), _human(spark, d).select("key", (F.col("verdict") == "match").alias("match")))


VOTED = ", voted AS (SELECT prompt AS key, CASE rating_level % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'borderline' END AS a, CASE WHEN response_time_ms % 5 < 4 THEN 'yes' ELSE 'no' END AS b FROM ratings)"


def _voted(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("rating_level") % 3 == 0, "yes").when(F.col("rating_level") % 3 == 1, "no").otherwise("borderline")
    return ratings(spark, d).select(F.col("prompt").alias("item"), a.alias("a"), F.when(F.col("response_time_ms") % 5 < 4, "yes").otherwise("no").alias("b"))


def _strata(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = items(spark, d)
    return i.select(F.col("question_id").alias("item"), F.col("category").alias("stratum"), (F.col("question_id") % 3 > 0).alias("decided")), i.groupBy(F.col("category").alias("stratum")).agg(F.count(F.lit(1)).alias("population"))


@query("stratified_agreement", over("ratings items", VOTED + f""", m AS (SELECT key AS question_id, {majority_sql('a')} AS t FROM voted GROUP BY 1), p AS (SELECT category AS stratum, count(*) AS population FROM items GROUP BY 1),
g AS (SELECT category AS stratum, count(t) AS scored, count(*) FILTER (t = (question_id % 3 > 0)) AS agree, count(*) FILTER (t IS NULL) AS no_majority FROM items JOIN m USING (question_id) GROUP BY 1),
j AS (SELECT stratum, population, coalesce(scored, 0) AS scored, coalesce(agree, 0) AS agree, coalesce(no_majority, 0) AS no_majority FROM p LEFT JOIN g USING (stratum))
SELECT *, population / CAST(sum(population) OVER () AS DOUBLE) AS share, agree / CAST(nullif(scored, 0) AS DOUBLE) AS agreement, sum(CASE WHEN scored > 0 THEN population * (1 - agree / CAST(scored AS DOUBLE)) END) OVER () / CAST(sum(CASE WHEN scored > 0 THEN population END) OVER () AS DOUBLE) AS weighted_error,
(SELECT count(DISTINCT key) FROM voted) AS items, {_fleiss_sql('voted', 'a')} AS fleiss_kappa FROM j"""))
def stratified_agreement(spark: SparkSession, d: str) -> DataFrame:
    decisions, pops = _strata(spark, d)
    return R.stratified_agreement(_voted(spark, d).select("item", F.col("a").alias("vote")), decisions, pops)


@query("field_report", over("ratings items", VOTED + f""", o AS (SELECT 'a' AS field, key, {majority_sql('a')} AS ok FROM voted GROUP BY 2 UNION ALL SELECT 'b', key, {majority_sql('b')} FROM voted GROUP BY 2), p AS (SELECT category AS stratum, count(*) AS population FROM items GROUP BY 1),
g AS (SELECT field, category AS stratum, count(*) AS items, count(ok) AS scored, count(*) FILTER (NOT ok) AS wrong FROM o JOIN items ON key = question_id GROUP BY 1, 2),
w AS (SELECT field, CAST(sum(items) AS BIGINT) AS items, CAST(sum(items) - sum(scored) AS BIGINT) AS splits, CAST(sum(wrong) AS BIGINT) AS wrong, sum(population * (wrong / CAST(scored AS DOUBLE))) FILTER (scored > 0) / CAST(sum(population) FILTER (scored > 0) AS DOUBLE) AS error FROM g JOIN p USING (stratum) GROUP BY 1)
SELECT *, CASE field WHEN 'a' THEN {_fleiss_sql('voted', 'a')} ELSE {_fleiss_sql('voted', 'b')} END AS fleiss_kappa, CASE WHEN error <= 0.05e0 THEN 'pass' WHEN error <= 0.1e0 THEN 'repair' ELSE 'revise' END AS decision FROM w"""))
def field_report(spark: SparkSession, d: str) -> DataFrame:
    strata, pops = _strata(spark, d)
    return R.field_report(_voted(spark, d).join(strata.select("item", "stratum"), "item"), pops, ["a", "b"])


@query("field_failures", over("ratings", VOTED + f" SELECT 'a' AS field, key AS item FROM voted GROUP BY 2 HAVING NOT ({majority_sql('a')}) UNION ALL SELECT 'b', key FROM voted GROUP BY 2 HAVING NOT ({majority_sql('b')})"))
def field_failures(spark: SparkSession, d: str) -> DataFrame:
    strata, _ = _strata(spark, d)
    return R.field_failures(_voted(spark, d).join(strata.select("item", "stratum"), "item"), ["a", "b"])


POLICY = f"""{VIEWS}, p0 AS (SELECT CASE WHEN question_id % 20 = 0 THEN 'study' ELSE 'remainder' END AS view, correct_count, k, unnest([{{'policy': 'classifier', 'p': probability}}, {{'policy': 'cloud', 'p': 0e0}}, {{'policy': 'category', 'p': mean_rate}}]) AS u FROM forecasts JOIN split USING (question_id) JOIN m USING (category) WHERE split = 'test'),
p AS (SELECT view, u.policy AS policy, u.p AS probability, correct_count, k FROM p0 UNION ALL SELECT 'combined', u.policy, u.p, correct_count, k FROM p0), lv AS (SELECT view || policy AS vp, CAST(least(6 * correct_count // k, 5) AS INT) AS a, CAST(least(floor(probability * 6), 5) AS INT) AS b, 2 * correct_count >= k AS t, probability >= 0.5e0 AS s FROM p),
l AS (SELECT view, policy, view || policy AS vp, {LIKE} FROM p GROUP BY 1, 2), c AS (SELECT vp, avg(b - a) AS bias, avg(abs(b - a)) AS mae_levels, {TABLE} FROM lv GROUP BY 1),
q AS (SELECT view, policy, l.n, log_loss, sqrt(brier) AS rmse, brier, mae, CASE WHEN e > 0 THEN CAST(e - kx.n * o AS DOUBLE) / e END AS kappa, bias, mae_levels, accuracy, fpr, fnr FROM l JOIN (SELECT *, {RATES} FROM c) USING (vp) JOIN (SELECT vp, n, o, e FROM {_kappa_sql('lv', 'vp')}) kx USING (vp))"""


def _policy_table(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).join(split(spark, d), "question_id")
    m = f.where("split = 'train'").groupBy("category").agg(F.avg(F.col("correct_count") / F.col("k")).alias("mean_rate"))
    t = f.where("split = 'test'").join(m, "category").withColumn("view", F.when(F.col("question_id") % 20 == 0, "study").otherwise("remainder"))
    return R.policy_table(t, {"classifier": F.col("probability"), "cloud": F.lit(0.0), "category": F.col("mean_rate")})


@query("policy_table", over("forecasts split", POLICY + " SELECT * FROM q"))
def policy_table(spark: SparkSession, d: str) -> DataFrame:
    return _policy_table(spark, d)


@query("policy_differences", over("forecasts split", POLICY + ", z AS (SELECT view, policy, unnest([" + ", ".join(f"{{'metric': '{x}', 'v': {x}}}" for x in R.POLICY_METRICS) + "], recursive := true) FROM q) SELECT view, metric, x.v - y.v AS difference FROM z x JOIN z y USING (view, metric) WHERE x.policy = 'classifier' AND y.policy = 'category'"))
def policy_differences(spark: SparkSession, d: str) -> DataFrame:
    return R.policy_differences(_policy_table(spark, d), "classifier", "category")


SEGMENTS = {"automobile": "goods", "building": "goods", "furniture": "goods", "household": "home", "unused": "unused"}
ANSWERS = "SELECT CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN NULL ELSE ' ' || c_mktsegment END AS answer FROM customer"


@query("segment_report", f"""WITH n AS (SELECT CASE lower(trim(coalesce(answer, ''))) WHEN '' THEN 'not reported' {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())} ELSE 'ambiguous' END AS category FROM ({ANSWERS})),
g AS (SELECT c.category, count(n.category) AS n FROM (SELECT unnest(['goods', 'home', 'unused', 'ambiguous', 'not reported']) AS category) c LEFT JOIN n USING (category) GROUP BY 1),
t AS (SELECT *, CAST(CASE WHEN category IN ('ambiguous', 'not reported') THEN sum(n) OVER () ELSE sum(n) FILTER (category NOT IN ('ambiguous', 'not reported')) OVER () END AS BIGINT) AS denominator FROM g)
SELECT category, n, denominator, round_even(100e0 * n / denominator, 1) AS percent FROM t""")
def segment_report(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    answer = F.when(i % 7 == 0, " ").when(i % 11 == 0, None).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return R.category_report(read(spark, d, "customer").select(answer.alias("answer")), "answer", SEGMENTS)


RECORDS = """, r AS (SELECT question_id, question_id % 19 = 0 AS error, convertible, CASE WHEN question_id % 23 = 0 THEN 'rewrite_error' ELSE stage END AS stage, CASE WHEN question_id % 4 > 0 THEN score END AS t, CASE WHEN NOT convertible THEN stage ELSE '' END AS failure, coalesce(question, '') AS w,
CASE WHEN question_id % 2 = 0 THEN coalesce(question, '') ELSE 'Which holds?' END AS q, CASE WHEN question_id % 31 = 0 THEN ' ' WHEN question_id % 5 = 0 THEN 'Which OF THESE: ' || coalesce(question, '') ELSE coalesce(question, '') END AS o FROM corpus),
f AS (SELECT *, regexp_matches(o, '\\b(of the following|of these|following statements|statements above|listed above|options above)\\b', 'i') AS stuck, length(a) >= 8 AND contains(lower(o), a) AND NOT contains(lower(q), a) AS leak FROM (SELECT *, lower(trim(substring(w, 5, 20), ' ')) AS a FROM r))"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    i, w = F.col("question_id"), F.coalesce("question", F.lit(""))
    tokens = F.when(i % 4 > 0, F.struct(F.col("score").alias("in"), (F.col("score") * 2).alias("out")))
    rewrite = F.when(i % 31 == 0, " ").when(i % 5 == 0, F.concat(F.lit("Which OF THESE: "), w)).otherwise(w)
    return corpus(spark, d).select("question_id", (i % 19 == 0).alias("error"), "convertible", F.when(i % 23 == 0, "rewrite_error").otherwise(F.col("stage")).alias("stage"), tokens.alias("tokens"), F.when(~F.col("convertible"), F.col("stage")).otherwise("").alias("failure"),
                                   F.when(i % 2 == 0, w).otherwise("Which holds?").alias("question"), rewrite.alias("open_question"), F.substring(w, 5, 20).alias("reference_answer"))


@query("conversion_report", over("corpus", RECORDS + """ SELECT count(*) FILTER (NOT error) AS decided, count(*) FILTER (error) AS failed, count(*) FILTER (NOT error AND convertible) AS convertible, count(*) FILTER (NOT error AND stage = 'rescore') AS rescored, count(*) FILTER (NOT error AND stage = 'rescore' AND convertible) AS readmitted,
CAST(coalesce(sum(t) FILTER (NOT error), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(2 * t) FILTER (NOT error), 0) AS BIGINT) AS tokens_out, count(t) FILTER (NOT error) AS counted, count(*) FILTER (NOT error AND convertible AND stuck) AS dangling, count(*) FILTER (NOT error AND convertible AND leak) AS answer_leaks,
count(*) FILTER (NOT error AND convertible AND trim(o, ' ') = '') AS empty, count(*) FILTER (NOT error AND stage = 'rewrite_error') AS rewrite_errors, count(*) FILTER (NOT error AND convertible) / CAST(count(*) FILTER (NOT error) AS DOUBLE) AS rate,
count(*) FILTER (NOT error AND stage = 'rescore' AND convertible) / CAST(count(*) FILTER (NOT error AND stage = 'rescore') AS DOUBLE) AS readmission_rate FROM f"""))
def conversion_report(spark: SparkSession, d: str) -> DataFrame:
    return R.conversion_report(_records(spark, d))


@query("failure_modes", over("corpus", RECORDS + " SELECT failure, count(*) AS n FROM f WHERE NOT error AND failure <> '' GROUP BY 1"))
def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    return R.failure_modes(_records(spark, d))


@query("audit_first", over("corpus", RECORDS + " (SELECT 'dangling' AS fault, question_id FROM f WHERE NOT error AND convertible AND stuck ORDER BY 2 LIMIT 10) UNION ALL (SELECT 'leak', question_id FROM f WHERE NOT error AND convertible AND leak ORDER BY 2 LIMIT 10)"))
def audit_first(spark: SparkSession, d: str) -> DataFrame:
    return R.audit_first(_records(spark, d))


@query("annotation_forms", over("corpus", """, n AS (SELECT unnest(['ann', 'bo', 'cy']) AS annotator), b AS (SELECT 'blind' AS form, question_id, annotator, row_number() OVER (PARTITION BY annotator ORDER BY md5(concat_ws(':', '4', annotator, question_id)) || ':' || question_id) AS place FROM corpus, n),
w AS (SELECT 'rewrite' AS form, question_id, annotator, row_number() OVER (PARTITION BY annotator ORDER BY md5(concat_ws(':', '5', annotator, question_id)) || ':' || question_id) AS place FROM corpus, n WHERE convertible AND coalesce(question, '') <> '')
SELECT *, '' AS first_verdict, '' AS second_verdict, '' AS why FROM (SELECT * FROM b UNION ALL SELECT * FROM w)"""))
def annotation_forms(spark: SparkSession, d: str) -> DataFrame:
    """The blind form of all items and the rewrite form of the convertible ones."""
    c, blanks = corpus(spark, d), ["first_verdict", "second_verdict", "why"]
    blind = R.annotation_forms(c.select("question_id"), ["ann", "bo", "cy"], 4, "question_id", blanks).withColumn("form", F.lit("blind"))
    kept = c.where("convertible and question <> ''").select("question_id")
    return blind.unionByName(R.annotation_forms(kept, ["ann", "bo", "cy"], 5, "question_id", blanks).withColumn("form", F.lit("rewrite")))
