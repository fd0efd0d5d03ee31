"""Queries of agreement statistics (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.functions.expr import probability_level, truth_level
from routecast.operators import agreement as A
from routecast.operators import panel as P
from routecast.plans.views import corpus, forecasts, items, majority_sql, over, ratings, read, v_labels, verdicts
from routecast.registry import query
from routecast.sources.shared import written

LEVELS = ", lv AS (SELECT *, CAST(least(6 * correct_count // k, 5) AS INT) AS a, CAST(least(floor(probability * 6), 5) AS INT) AS b FROM forecasts)"
RATED = ", lv AS (SELECT rater, prompt, CAST(least(6 * correct_count // k, 5) AS INT) AS a, rating_level AS b FROM ratings JOIN v_labels ON prompt = question_id)"
KAPPA = """(SELECT {g} count(*) AS n, sum(abs(a - b)) AS o FROM {t} {by}) x {j} (SELECT {rg} sum(abs(ra.a - rb.b) * ra.n * rb.n) AS e FROM (SELECT {g} a, count(*) AS n FROM {t} GROUP BY {g} a) ra JOIN (SELECT {g} b, count(*) AS n FROM {t} GROUP BY {g} b) rb ON {on} {rby}) y {using}"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    return f.select("question_id", "category", truth_level(F.col("correct_count"), F.col("k")).alias("truth"), probability_level(F.col("probability")).alias("said"))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    l = v_labels(spark, d).select(F.col("question_id").alias("prompt"), truth_level(F.col("correct_count"), F.col("k")).alias("truth_level"))
    return ratings(spark, d).join(l, "prompt")


def _kappa_sql(table: str, group: str) -> str:
    g = group + ","
    return KAPPA.format(g=g, t=table, by=f"GROUP BY {group}", j="JOIN", rg=f"ra.{group},", on=f"ra.{group} = rb.{group}", rby=f"GROUP BY ra.{group}", using=f"USING ({group})")


@query("kappa_by_category", over("forecasts", LEVELS + " SELECT category, n, CAST(e - n * o AS DOUBLE) AS numerator, CAST(e AS DOUBLE) AS denominator, CASE WHEN e > 0 THEN CAST(e - n * o AS DOUBLE) / e END AS kappa FROM " + _kappa_sql("lv", "category")))
def kappa_by_category(spark: SparkSession, d: str) -> DataFrame:
    k = A.weighted_kappa(A.cells(_levels(spark, d), "truth", "said", ["category"]), ["category"])
    return k.withColumns({"numerator": F.col("numerator").cast("double"), "denominator": F.col("denominator").cast("double")})


@query("kappa_conventions", """
SELECT g, n, CASE g WHEN 'equal' THEN NULL WHEN 'apart' THEN 0e0 END AS kappa, CASE g WHEN 'equal' THEN 1e0 WHEN 'apart' THEN 0e0 END AS kappa_one FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'equal' ELSE 'apart' END AS g, count(*) AS n FROM documents GROUP BY 1)""")
def kappa_conventions(spark: SparkSession, d: str) -> DataFrame:
    """A2, A3: both raters constant and equal (undefined or 1), constant and apart (0)."""
    t = read(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "equal").otherwise("apart").alias("g"), F.lit(2).alias("a"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(4).alias("b"))
    c = A.cells(t, "a", "b", ["g"])
    one = A.weighted_kappa(c, ["g"], "one").select("g", F.col("kappa").alias("kappa_one"))
    return A.weighted_kappa(c, ["g"]).select("g", "n", "kappa").join(one, "g")


@query("scotts_pi", """
SELECT n, same, (s - c) / (1 - c) AS pi FROM (SELECT n, same, same * 1e0 / n AS s, p * p + (1 - p) * (1 - p) AS c FROM (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, (sum(quality) + sum(toxic)) / (2e0 * count(*)) AS p FROM labels))""")
def scotts_pi(spark: SparkSession, d: str) -> DataFrame:
    return A.scotts_pi(read(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("alpha_ordinal", over("ratings", """, n AS (SELECT prompt, rating_level AS a, count(*) AS n, sum(count(*)) OVER (PARTITION BY prompt) AS m FROM ratings GROUP BY 1, 2),
o AS (SELECT x.a AS a, y.a AS b, sum((x.n * y.n - CASE WHEN x.a = y.a THEN x.n ELSE 0 END) / CAST(x.m - 1 AS DOUBLE)) AS o FROM n x JOIN n y USING (prompt) WHERE x.m >= 2 GROUP BY 1, 2),
c AS (SELECT a, sum(o) AS c, (SELECT sum(o) FROM o) AS t FROM o GROUP BY 1),
d AS (SELECT x.a AS a, y.a AS b, x.c AS ca, y.c AS cb, x.t AS t, ((SELECT sum(c) FROM c z WHERE z.a BETWEEN least(x.a, y.a) AND greatest(x.a, y.a)) - (x.c + y.c) / 2) AS mid FROM c x, c y)
SELECT CAST(round(max(t)) AS BIGINT) AS "values", 1 - sum(coalesce(o.o, 0) * mid * mid) / sum((ca * cb - CASE WHEN d.a = d.b THEN ca ELSE 0 END) / (t - 1) * mid * mid) AS alpha FROM d LEFT JOIN o ON o.a = d.a AND o.b = d.b"""))
def alpha_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return A.ordinal_alpha(ratings(spark, d), "prompt", "rating_level")


RATES = "fp / CAST(nullif(fp + tn, 0) AS DOUBLE) AS fpr, fn / CAST(nullif(fn + tp, 0) AS DOUBLE) AS fnr, (tp + fp) / CAST(nullif(tn + fp + fn + tp, 0) AS DOUBLE) AS coverage, tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS precision, (tp + tn) / CAST(nullif(tn + fp + fn + tp, 0) AS DOUBLE) AS accuracy"


@query("confusion_by_category", over("forecasts", f""", c AS (SELECT category, count(*) FILTER (NOT t AND NOT s) AS tn, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (t AND s) AS tp FROM (SELECT category, 2 * correct_count >= k AS t, probability >= 0.5e0 AS s FROM forecasts) GROUP BY 1) SELECT *, {RATES} FROM c"""))
def confusion_by_category(spark: SparkSession, d: str) -> DataFrame:
    return A.confusion(forecasts(spark, d), F.col("correct_count") * 2 >= F.col("k"), F.col("probability") >= 0.5, ["category"])


@query("tau_b", over("forecasts", LEVELS + """, p AS (SELECT x.category, sign(x.a - y.a) AS da, sign(x.b - y.b) AS db FROM lv x JOIN lv y ON x.category = y.category AND x.question_id < y.question_id)
SELECT category, con AS concordant, dis AS discordant, (con - dis) / sqrt(CAST(con + dis + ta AS DOUBLE) * (con + dis + tb)) AS tau_b FROM (SELECT category, count(*) FILTER (da * db > 0) AS con, count(*) FILTER (da * db < 0) AS dis, count(*) FILTER (da * db = 0 AND da = 0 AND db <> 0) AS ta, count(*) FILTER (da <> 0 AND db = 0) AS tb FROM p GROUP BY 1)"""))
def tau_b(spark: SparkSession, d: str) -> DataFrame:
    return A.tau_b(A.cells(_levels(spark, d), "truth", "said", ["category"]), ["category"])


TAIL = "(SELECT sum(factorial(m) / (factorial(i) * factorial(m - i))) FROM (SELECT m, unnest(range({0}, m + 1))::INT AS i)) / pow(2e0, m)"


@query("mcnemar", f"WITH s AS (SELECT DISTINCT s_suppkey AS source, s_suppkey % 5 AS fp, s_suppkey % 3 AS fn, CAST(s_suppkey % 5 + s_suppkey % 3 AS INT) AS m FROM supplier) SELECT source, fp, fn, {TAIL.format('fp')} AS p_false_local, {TAIL.format('fn')} AS p_false_cloud FROM s")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 5).alias("fp"), (F.col("s_suppkey") % 3).alias("fn")).distinct()
    return A.mcnemar(s)


DESCRIBE = "avg(b - a) AS bias, avg(abs(b - a)) AS mae, count(*) FILTER (a < 3 AND b < 3) AS tn, count(*) FILTER (a < 3 AND b >= 3) AS fp, count(*) FILTER (a >= 3 AND b < 3) AS fn, count(*) FILTER (a >= 3 AND b >= 3) AS tp, count(*) FILTER (a < 3 AND b >= 3) - count(*) FILTER (a >= 3 AND b < 3) AS net_local"


@query("rater_descriptors", over("ratings v_labels", RATED + f" SELECT rater, n, CASE WHEN e > 0 THEN CAST(e - n * o AS DOUBLE) / e END AS kappa, bias, mae, tn, fp, fn, tp, net_local, lowest FROM {_kappa_sql('lv', 'rater')} JOIN (SELECT rater, {DESCRIBE}, count(*) FILTER (b = 0) AS lowest FROM lv GROUP BY 1) z USING (rater)"))
def rater_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """A10, A11."""
    r = _rated(spark, d)
    low = r.groupBy("rater").agg(F.count_if(F.col("rating_level") == 0).alias("lowest"))
    return A.pair_descriptors(r, "truth_level", "rating_level", ["rater"]).drop("numerator", "denominator").join(low, "rater")


@query("level_matrix", over("forecasts", LEVELS + ", g AS (SELECT CAST(unnest(range(6)) AS INT) AS truth) SELECT truth, " + ", ".join(f"count(b) FILTER (b = {i}) AS said_{i}" for i in range(6)) + " FROM g LEFT JOIN lv ON a = truth GROUP BY 1"))
def level_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.level_matrix(_levels(spark, d), "truth", "said")


@query("prompt_rows", over("ratings v_labels", """SELECT prompt, CAST(quantile_disc(rating_level, 0.5) AS INT) AS median_level, 2 * count(*) FILTER (rating_level >= 3) > count(*) AS local, true AS agrees, CAST(max(least(6 * correct_count // k, 5)) AS INT) AS truth_level, bool_and(2 * correct_count >= k) AS local_truth, CAST(count(*) AS INT) AS ratings, sum(response_time_ms) AS ms FROM ratings JOIN v_labels ON prompt = question_id GROUP BY 1"""))
def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    p = A.prompt_rows(ratings(spark, d), v_labels(spark, d), raters=None)
    ms = F.aggregate(F.transform("ratings", lambda r: r["response_time_ms"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("prompt", "median_level", "local", "agrees", "truth_level", "local_truth", F.size("ratings").alias("ratings"), ms.alias("ms"))


@query("level_use", over("ratings", "SELECT g.level, count(rater) AS n, count(DISTINCT rater) AS raters FROM (SELECT CAST(unnest(range(6)) AS INT) AS level) g LEFT JOIN ratings ON rating_level = g.level GROUP BY 1"))
def level_use(spark: SparkSession, d: str) -> DataFrame:
    return A.level_use(ratings(spark, d))


@query("level_transitions", over("trials", """, x AS (SELECT question_id, model, least(6 * count(*) FILTER (success) // count(*), 5) AS level FROM trials GROUP BY 1, 2)
SELECT CAST(a.level AS INT) AS before, CAST(b.level AS INT) AS after, count(*) AS n FROM x a JOIN x b USING (question_id) WHERE a.model = 0 AND b.model = 1 GROUP BY 1, 2"""))
def level_transitions(spark: SparkSession, d: str) -> DataFrame:
    from routecast.plans.views import trials

    x = trials(spark, d).groupBy("question_id", "model").agg(F.count_if("success").alias("c"), F.count(F.lit(1)).alias("k")).withColumn("level", truth_level(F.col("c"), F.col("k")))
    return A.transitions(x.where("model = 0"), x.where("model = 1"), "question_id", "level")


def _removal_sql(keep: str, select: str, by: str) -> str:
    return f""", br AS (SELECT {by} prompt, list_sort(list(rating_level)) AS l FROM {keep} GROUP BY {by} prompt),
lv AS (SELECT {by} u.branch AS branch, u.b AS b, CAST(least(6 * correct_count // k, 5) AS INT) AS a FROM (SELECT {by} prompt, unnest([{{'branch': 'lower', 'b': l[(len(l) - 1) // 2 + 1]}}, {{'branch': 'upper', 'b': l[len(l) // 2 + 1]}}]) AS u FROM br) JOIN v_labels ON prompt = question_id) {select}"""


@query("after_removal", over("ratings v_labels", _removal_sql("(SELECT * FROM ratings WHERE rater % 7 <> 0)", f"SELECT branch, n, CASE WHEN e > 0 THEN CAST(e - n * o AS DOUBLE) / e END AS kappa, bias, mae, tn, fp, fn, tp, net_local FROM {_kappa_sql('lv', 'branch')} JOIN (SELECT branch, {DESCRIBE} FROM lv GROUP BY 1) z USING (branch)", "")))
def after_removal(spark: SparkSession, d: str) -> DataFrame:
    """A15, A20."""
    r = _rated(spark, d)
    truth = r.select("prompt", "truth_level").distinct()
    return A.after_removal(r, truth, r.where("rater % 7 = 0")).drop("numerator", "denominator")


@query("leave_one_rater_out", over("ratings v_labels", _removal_sql("(SELECT q.removed, x.* FROM ratings x JOIN (SELECT DISTINCT rater AS removed FROM ratings) q ON q.removed <> x.rater)", f""", lz AS (SELECT *, removed || branch AS rb FROM lv)
SELECT z.removed, z.branch, x.n, CASE WHEN e > 0 THEN CAST(e - n * o AS DOUBLE) / e END AS kappa, z.fp, z.fn FROM {_kappa_sql('lz', 'rb')} JOIN (SELECT rb, any_value(removed) AS removed, any_value(branch) AS branch, count(*) FILTER (a < 3 AND b >= 3) AS fp, count(*) FILTER (a >= 3 AND b < 3) AS fn FROM lz GROUP BY 1) z USING (rb)""", "removed,")))
def leave_one_rater_out(spark: SparkSession, d: str) -> DataFrame:
    r = written(_rated(spark, d).select("prompt", "rater", "rating_level", "truth_level"))
    return A.leave_one_out(r, r.select("prompt", "truth_level").distinct()).select("removed", "branch", "n", "kappa", "fp", "fn")


RATER_MEANS = ", m AS (SELECT rater, avg(rating_level) AS v FROM ratings GROUP BY 1)"


def _rater_means(spark: SparkSession, d: str) -> DataFrame:
    return ratings(spark, d).groupBy("rater").agg(F.avg("rating_level").alias("v"))


@query("rater_iqr_fences", over("ratings", RATER_MEANS + ", q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM m) SELECT rater, v, a - 1.5e0 * (b - a) AS low, b + 1.5e0 * (b - a) AS high FROM m, q WHERE v < a - 1.5e0 * (b - a) OR v > b + 1.5e0 * (b - a)"))
def rater_iqr_fences(spark: SparkSession, d: str) -> DataFrame:
    return A.iqr_fences(_rater_means(spark, d), "v")


@query("rater_mad_fences", over("ratings", RATER_MEANS + ", q AS (SELECT median(v) AS c FROM m), w AS (SELECT c, median(abs(v - c)) AS w FROM m, q GROUP BY c) SELECT rater, v, c - 2 * 1.4826e0 * w AS low, c + 2 * 1.4826e0 * w AS high FROM m, w WHERE v < c - 2 * 1.4826e0 * w OR v > c + 2 * 1.4826e0 * w"))
def rater_mad_fences(spark: SparkSession, d: str) -> DataFrame:
    return A.mad_fences(_rater_means(spark, d), "v")


@query("judge_scores", over("verdicts", """, c AS (SELECT key, count(*) FILTER (verdict = 'match') >= 2 AS t FROM verdicts GROUP BY 1), j AS (SELECT judge, t, verdict = 'match' AS s FROM verdicts JOIN c USING (key)),
g AS (SELECT judge, count(*) AS n, count(*) FILTER (NOT t AND NOT s) AS tn, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (t AND s) AS tp FROM j GROUP BY 1),
p AS (SELECT *, (tn + tp) * 1e0 / n AS o, (2 * tp + fp + fn) / (2e0 * n) AS y FROM g), q AS (SELECT *, (o - (y * y + (1 - y) * (1 - y))) / (1 - (y * y + (1 - y) * (1 - y))) AS pi FROM p)
SELECT judge, n, pi, tn, fp, fn, tp, pi >= 0.8e0 AS passes, fp >= 8 AND fp > 2e0 * (SELECT count(*) FILTER (NOT t) / CAST(count(*) FILTER (t) AS DOUBLE) FROM c) * greatest(fn, 1) AS lenient FROM q"""))
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d)
    return A.judge_scores(v, P.consensus(v))


DECISIONS = "(SELECT doc_id AS id, 'r1' AS run, n_chars % 3 > 0 AS kept FROM documents UNION ALL SELECT doc_id, 'r2', n_chars % 5 > 0 FROM documents)"


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.explode(F.array(F.struct(F.lit("r1").alias("run"), (F.col("n_chars") % 3 > 0).alias("kept")), F.struct(F.lit("r2").alias("run"), (F.col("n_chars") % 5 > 0).alias("kept")))).alias("x")).select("id", "x.*")


@query("run_scores", f"""SELECT run, count(*) AS n, count(*) FILTER ((l = 'keep') = kept) AS agree, count(*) FILTER (l = 'drop' AND kept) AS false_accept, count(*) FILTER (l = 'keep' AND NOT kept) AS false_reject, count(*) FILTER (kept) AS kept
FROM {DECISIONS} JOIN (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'borderline' WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS l FROM labels) USING (id) WHERE l <> 'borderline' GROUP BY 1""")
def run_scores(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "borderline").when(F.col("quality") == 1, "keep").otherwise("drop").alias("label"))
    return A.run_scores(_decisions(spark, d), l)


@query("run_flips", f"SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, count(*) FILTER (a.kept <> b.kept) AS flips, count(*) FILTER (a.kept <> b.kept) / CAST(count(*) AS DOUBLE) AS rate FROM {DECISIONS} a JOIN {DECISIONS} b USING (id) WHERE a.run < b.run GROUP BY 1, 2")
def run_flips(spark: SparkSession, d: str) -> DataFrame:
    return A.flips(_decisions(spark, d))


VOTES = "(SELECT l_partkey AS item, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'borderline' END AS vote FROM lineitem)"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    vote = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("borderline")
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), vote.alias("vote"))


@query("stratified_error", over("items", f""", m AS (SELECT item, {majority_sql('vote')} AS t FROM {VOTES} GROUP BY 1),
p AS (SELECT category AS stratum, count(*) AS population FROM items GROUP BY 1), g AS (SELECT category AS stratum, count(t) AS scored, count(*) FILTER (t = (question_id % 3 > 0)) AS agree, count(*) FILTER (t IS NULL) AS no_majority FROM items JOIN m ON item = question_id GROUP BY 1)
SELECT stratum, population, population / CAST(sum(population) OVER () AS DOUBLE) AS share, scored, agree, no_majority, sum(CASE WHEN scored > 0 THEN population * (1 - agree / CAST(scored AS DOUBLE)) END) OVER () / CAST(sum(CASE WHEN scored > 0 THEN population END) OVER () AS DOUBLE) AS weighted_error FROM p JOIN g USING (stratum)"""))
def stratified_error(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    pops = i.groupBy(F.col("category").alias("stratum")).agg(F.count(F.lit(1)).alias("population"))
    return A.stratified_error(_votes(spark, d), i.select(F.col("question_id").alias("item"), F.col("category").alias("stratum"), (F.col("question_id") % 3 > 0).alias("decided")), pops)


@query("field_errors", over("items", f""", v AS (SELECT l_partkey AS item, unnest([{{'field': 'meaning', 'vote': CASE WHEN l_quantity < 30 THEN 'yes' ELSE 'no' END}}, {{'field': 'self_contained', 'vote': CASE WHEN l_tax < 0.07e0 THEN 'yes' ELSE 'no' END}}], recursive := true) FROM lineitem),
m AS (SELECT field, item, {majority_sql('vote')} AS ok FROM v GROUP BY 1, 2), p AS (SELECT category AS stratum, count(*) AS population FROM items GROUP BY 1),
g AS (SELECT field, category AS stratum, count(ok) AS scored, count(*) FILTER (NOT ok) AS wrong FROM m JOIN items ON item = question_id GROUP BY 1, 2), e AS (SELECT field, sum(population * (wrong / CAST(scored AS DOUBLE))) / sum(population) AS error, CAST(sum(wrong) AS BIGINT) AS wrong FROM g JOIN p USING (stratum) WHERE scored > 0 GROUP BY 1)
SELECT *, CASE WHEN error <= 0.05e0 THEN 'pass' WHEN error <= 0.1e0 THEN 'repair' ELSE 'revise' END AS decision FROM e"""))
def field_errors(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    v = read(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.when(F.col("l_quantity") < 30, "yes").otherwise("no").alias("meaning"), F.when(F.col("l_tax") < 0.07, "yes").otherwise("no").alias("self_contained"))
    pops = i.groupBy(F.col("category").alias("stratum")).agg(F.count(F.lit(1)).alias("population"))
    return A.field_errors(v.join(i.select(F.col("question_id").alias("item"), F.col("category").alias("stratum")), "item"), pops, ["meaning", "self_contained"])


@query("stratum_populations", over("corpus", """SELECT CASE WHEN score BETWEEN 4 AND 7 THEN 'borderline' WHEN convertible THEN CASE WHEN stage = 'judge' THEN 'kept_judge' ELSE 'kept_rescore' END ELSE CASE WHEN stage = 'rewrite' THEN 'drop_rewrite' ELSE 'drop_rescore' END END AS stratum,
count(*) AS population, count(*) FILTER (convertible) AS retained FROM corpus GROUP BY 1"""))
def stratum_populations(spark: SparkSession, d: str) -> DataFrame:
    return A.populations(corpus(spark, d))
