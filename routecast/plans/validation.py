"""Queries of validation and key coverage (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.functions.expr import stratum
from routecast.operators import checks as C
from routecast.plans.views import corpus, forecasts, items, over, ratings, read, split, trials, v_labels, verdicts
from routecast.registry import query


@query("duplicate_trials", over("trials", "SELECT question_id, rep, count(*) AS n FROM trials GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_trials(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(trials(spark, d), ["question_id", "rep"])


@query("violations", over("forecasts", """
SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT correct_count BETWEEN 1 AND k THEN 'count' END, CASE WHEN NOT probability BETWEEN 0.1e0 AND 1 THEN 'probability' END,
  CASE WHEN NOT category IN ('ECONOMY', 'SMALL', 'LARGE') THEN 'category' END, CASE WHEN NOT k >= 20 THEN 'k' END]) AS rule FROM forecasts) WHERE rule IS NOT NULL GROUP BY 1"""))
def violations(spark: SparkSession, d: str) -> DataFrame:
    return C.violations(forecasts(spark, d), {"count": F.col("correct_count").between(1, F.col("k")), "probability": F.col("probability").between(0.1, 1.0),
                                              "category": F.col("category").isin("ECONOMY", "SMALL", "LARGE"), "k": F.col("k") >= 20})


@query("key_coverage", over("verdicts", """, j AS (SELECT DISTINCT judge FROM verdicts), a AS (SELECT DISTINCT key FROM verdicts WHERE judge = 'J0'), b AS (SELECT DISTINCT key FROM verdicts WHERE judge = 'J1')
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' ELSE 'extra' END AS side FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL"""))
def key_coverage(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d)
    return C.key_difference(v.where("judge = 'J0'"), v.where("judge = 'J1'"), "key")


@query("set_relations", """
SELECT 'outside' AS relation, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'overlap', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def set_relations(spark: SparkSession, d: str) -> DataFrame:
    a, b = read(spark, d, "documents"), read(spark, d, "labels")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
    return count(C.outside(a, b, "doc_id"), "outside").union(count(C.overlap(a, b, "doc_id"), "overlap"))


@query("attribute_agreement", over("items", "SELECT question_id, unnest(CASE WHEN question_id % 6 = 0 THEN ['category', 'text'] WHEN question_id % 3 = 0 THEN ['category'] WHEN question_id % 2 = 0 THEN ['text'] ELSE [] END) AS field FROM items"))
def attribute_agreement(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    changed = i.select("question_id", F.when(F.col("question_id") % 3 == 0, None).otherwise(F.col("category")).alias("category"),
                       F.when(F.col("question_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return C.disagreements(i, changed, "question_id", ["category", "text"])


@query("unstable_fields", """
SELECT question_id, field, n FROM (SELECT l_partkey AS question_id, unnest([{'field': 'model', 'n': count(DISTINCT l_suppkey % 3)}, {'field': 'flag', 'n': count(DISTINCT l_returnflag)}], recursive := true) FROM lineitem GROUP BY 1) WHERE n > 1""")
def unstable_fields(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").select(F.col("l_partkey").alias("question_id"), (F.col("l_suppkey") % 3).alias("model"), F.col("l_returnflag").alias("flag"))
    return C.unstable(t, "question_id", ["model", "flag"])


@query("answer_key_faults", over("items", """, k AS (SELECT question_id, text, category, question_id % 2 AS answer_index FROM items WHERE question_id % 11 <> 0), l AS (SELECT * FROM items WHERE question_id % 13 <> 0)
SELECT coalesce(k.question_id, l.question_id) AS question_id, CASE WHEN l.question_id IS NULL THEN 'no_label' WHEN k.question_id IS NULL THEN 'no_key' WHEN k.question_id % 5 = 0 THEN 'wrong_text' ELSE 'identity' END AS fault
FROM k FULL OUTER JOIN l ON k.question_id = l.question_id WHERE l.question_id IS NULL OR k.question_id IS NULL OR k.question_id % 5 = 0 OR k.question_id % 7 = 0"""))
def answer_key_faults(spark: SparkSession, d: str) -> DataFrame:
    i, q = items(spark, d), F.col("question_id")
    key = i.where(q % 11 != 0).select("question_id", F.col("text").alias("question"), "category", F.array(F.col("text"), F.col("segment")).alias("options"), (q % 2).cast("int").alias("answer_index"))
    key = key.withColumn("answer_text", F.when(q % 5 == 0, F.lit("?")).otherwise(F.get("options", F.col("answer_index"))))
    labels = i.where(q % 13 != 0).select("question_id", F.col("text").alias("question"), F.when(q % 7 == 0, F.lit("other")).otherwise(F.col("category")).alias("category"))
    return C.answer_key_faults(key, labels)


@query("identity_changes", "SELECT l_partkey AS question_id, count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def identity_changes(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "question_id")
    return C.identity_changes(t, "question_id", ["l_returnflag", "l_linestatus"])


@query("equal_repeats", """
WITH t AS (SELECT p_partkey % 4 AS rep, p_partkey // 4 AS key, (p_partkey // 4 + CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END) % 3 AS r FROM part), p AS (SELECT rep, string_agg(key || '=' || r, ',' ORDER BY key) AS r FROM t GROUP BY 1)
SELECT a.rep AS rep_a, b.rep AS rep_b FROM p a JOIN p b ON a.r = b.r AND a.rep < b.rep""")
def equal_repeats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    key = F.floor(k / 4)
    t = read(spark, d, "part").select((k % 4).alias("rep"), key.alias("key"), ((key + F.when(k % 4 == 3, 1).otherwise(0)) % 3).cast("string").alias("response"))
    return C.equal_repeats(t, "rep", "key", "response")


@query("count_spread", over("v_labels", "SELECT coalesce(bool_or(correct_count > 0 AND correct_count < k), false) AS varied, count(*) FILTER (correct_count = 0) AS \"none\", count(*) FILTER (correct_count = k) AS \"all\", count(*) AS n FROM v_labels"))
def count_spread(spark: SparkSession, d: str) -> DataFrame:
    return C.spread(v_labels(spark, d))


@query("instruments", over("trials", "SELECT rep, 'model' AS field, count(DISTINCT model) AS n FROM trials GROUP BY 1 HAVING count(DISTINCT model) > 1"))
def instruments(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).withColumn("template", F.when(F.col("question_id") % 2 == 0, "t1"))
    return C.instruments(t, ["rep"], ["model", "template"], wildcard=("template",))


@query("manifest_difference", """
WITH a AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey % 7 <> 0), b AS (SELECT n_name AS key, CAST(n_regionkey + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS value FROM nation WHERE n_nationkey % 6 <> 0)
SELECT coalesce(a.key, b.key) AS key, a.value AS "left", b.value AS "right" FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def manifest_difference(spark: SparkSession, d: str) -> DataFrame:
    n, k = read(spark, d, "nation"), F.col("n_nationkey")
    a = n.where(k % 7 != 0).select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    b = n.where(k % 6 != 0).select(F.col("n_name").alias("key"), (F.col("n_regionkey") + F.when(k % 5 == 0, 1).otherwise(0)).cast("string").alias("value"))
    return C.manifest_difference(a, b)


@query("design_overlap", over("ratings", "SELECT x.rater AS a, y.rater AS b, count(*) AS shared FROM ratings x JOIN ratings y ON x.prompt = y.prompt AND x.rater < y.rater GROUP BY 1, 2"))
def design_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_overlap(ratings(spark, d), "rater", "prompt")


@query("design_faults", over("ratings items", """, g AS (SELECT rater, prompt, category FROM ratings JOIN items ON prompt = question_id)
SELECT rule, count(*) AS n FROM (SELECT 'category_count' AS rule FROM g GROUP BY rater, category HAVING count(*) <> 2 UNION ALL SELECT 'rater_count' FROM g GROUP BY prompt HAVING count(DISTINCT rater) <> 3) GROUP BY 1"""))
def design_faults(spark: SparkSession, d: str) -> DataFrame:
    g = ratings(spark, d).select(F.col("rater").alias("participant_id"), F.col("prompt").alias("question_id")).join(items(spark, d).select("question_id", "category"), "question_id")
    return C.design_faults(g.withColumnRenamed("question_id", "prompt_id"), 3, 2)


@query("stage_coverage", over("corpus", """, f AS (SELECT question_id, convertible FROM corpus), s AS (SELECT question_id, score = 4 AS convertible FROM corpus WHERE score <= 5),
w AS (SELECT question_id, question_id % 17 = 0 AS bad FROM corpus WHERE score >= 4 AND question_id % 9 <> 0), l AS (SELECT question_id FROM f WHERE convertible UNION SELECT question_id FROM s WHERE convertible)
SELECT question_id, 'no_second' AS fault FROM f WHERE NOT convertible AND question_id NOT IN (SELECT question_id FROM s) UNION ALL SELECT question_id, 'surplus_second' FROM s WHERE question_id NOT IN (SELECT question_id FROM f WHERE NOT convertible)
UNION ALL SELECT question_id, 'no_rewrite' FROM l WHERE question_id NOT IN (SELECT question_id FROM w) UNION ALL SELECT question_id, 'surplus_rewrite' FROM w WHERE question_id NOT IN (SELECT question_id FROM l)
UNION ALL SELECT question_id, 'failed' FROM w WHERE bad"""))
def stage_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    second = c.where("score <= 5").select("question_id", (F.col("score") == 4).alias("convertible"))
    rewrites = c.where("score >= 4 and question_id % 9 <> 0").select("question_id", F.when(F.col("question_id") % 17 == 0, "bad").alias("error"))
    return C.stage_coverage(c.select("question_id", "convertible"), second, rewrites)


@query("reconciliation", over("v_labels", "SELECT question_id, CAST(CASE WHEN question_id % 10 = 0 THEN correct_count + 1 ELSE correct_count END AS DOUBLE) AS stored, CAST(correct_count AS DOUBLE) AS computed FROM v_labels WHERE question_id % 10 = 0"))
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    computed = v_labels(spark, d).select("question_id", F.col("correct_count").cast("double").alias("value"))
    stored = computed.select("question_id", (F.col("value") + F.when(F.col("question_id") % 10 == 0, 1).otherwise(0)).alias("value"))
    return C.reconciliation(stored, computed, "question_id", "value")


@query("replay", over("forecasts", "SELECT count(*) AS n, max(abs(probability - (probability + 1e-7))) AS max_error, true AS agrees FROM forecasts"))
def replay(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).select("question_id", "probability")
    return C.replay(f, f.withColumn("probability", F.col("probability") + 1e-7), "question_id", "probability")


@query("allocation_audit", over("items", """, h AS (SELECT category, count(*) AS realised FROM items WHERE question_id % 2 = 0 GROUP BY 1), p AS (SELECT category, CAST(count(*) // 2 AS BIGINT) AS target FROM items GROUP BY 1)
SELECT category, target, coalesce(realised, 0) AS realised, CASE WHEN coalesce(realised, 0) = target THEN 'equal' WHEN realised > target THEN 'above' ELSE 'below' END AS state FROM p LEFT JOIN h USING (category)"""))
def allocation_audit(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    plan = i.groupBy("category").agg(F.floor(F.count(F.lit(1)) / 2).alias("target"))
    return C.allocation_audit(i.where("question_id % 2 = 0"), plan, ["category"])


@query("stimulus_faults", "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN turn % 5 = 0 THEN 'chars' END, CASE WHEN conv_id % 7 = 0 THEN 'key' END]) AS rule FROM conversations WHERE role = 'assistant') WHERE rule IS NOT NULL GROUP BY 1")
def stimulus_faults(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("role = 'assistant'")
    key = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("x"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))).otherwise(F.concat_ws(":", "conv_id", "turn"))
    chars = F.length("text") + F.when(F.col("turn") % 5 == 0, 1).otherwise(0)
    return C.stimulus_faults(c.select(key.alias("key"), F.col("conv_id").alias("question_id"), F.col("turn").alias("rep"), F.col("text").alias("response"), chars.alias("chars")))


@query("key_corpus_faults", over("corpus", "SELECT 'A' || question_id AS blind_id, CASE WHEN question_id % 5 = 0 THEN 'stratum' ELSE 'decision' END AS fault FROM corpus WHERE question_id % 5 = 0 OR question_id % 7 = 0"))
def key_corpus_faults(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question_id")
    c = corpus(spark, d).select("question_id", stratum(F.col("score"), F.col("convertible"), F.col("stage")).alias("stratum"), "convertible")
    key = c.select(F.concat(F.lit("A"), q.cast("string")).alias("blind_id"), "question_id", F.when(q % 5 == 0, "?").otherwise(F.col("stratum")).alias("stratum"), F.when(q % 7 == 0, ~F.col("convertible")).otherwise(F.col("convertible")).alias("convertible"))
    return C.key_corpus_faults(key, c)


@query("blind_design", "SELECT 'verdicts' AS rule, count(*) AS n FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT 'runs', count(*) FROM documents WHERE doc_id % 4 = 0")
def blind_design(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    order = read(spark, d, "documents").select(i.alias("id"), (i * 2 + 1).alias("blind_id"))
    both = order.select(F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("run"), "id").where("not (run = 'r2' and id % 4 = 0)")
    return C.blind_design(order, order.where("id % 6 <> 0"), both)


@query("matrix_faults", over("ratings", "SELECT prompt, 'raters' AS fault FROM ratings GROUP BY 1 HAVING count(DISTINCT rater) <> 12"))
def matrix_faults(spark: SparkSession, d: str) -> DataFrame:
    return C.matrix_faults(ratings(spark, d), 12)


@query("vote_faults", """
SELECT rater, fault, count(*) AS n FROM (SELECT 'R' || (doc_id % 2) AS rater, 'vote' AS fault FROM labels WHERE doc_id % 10 = 3
  UNION ALL SELECT r.rater, 'missing' FROM labels l, (VALUES ('R0'), ('R1')) r(rater) WHERE r.rater <> 'R' || (l.doc_id % 2)) GROUP BY 1, 2""")
def vote_faults(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "labels")
    v = l.select(F.concat(F.lit("R"), (F.col("doc_id") % 2).cast("string")).alias("rater"), F.lit(None).cast("long").alias("key"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 3, "maybe").otherwise("yes").alias("vote"))
    return C.vote_faults(v, l.select(F.col("doc_id").alias("id")))


@query("split_disjoint", over("split", "SELECT split, count(*) AS n FROM split GROUP BY 1"))
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
