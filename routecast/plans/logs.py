"""Queries of append-only logs (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.operators import logs as L
from routecast.plans.views import corpus, items, log, over, read
from routecast.registry import query


@query("latest_per_key", over("log", "SELECT key, event_id, error, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS p FROM log) WHERE p = 1"))
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(log(spark, d).select("key", "ts", "event_id", "error", "value"), "key", ["ts", "event_id"]).drop("ts")


@query("pending_items", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error' AND value > 20)")
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    done = log(spark, d).where("error or value > 20").select("key", "error")
    return L.pending(read(spark, d, "customer").select(F.col("c_custkey").alias("key")), done, "key", retry_errors=True)


@query("failed_keys", over("log", "SELECT key FROM (SELECT key, error, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS p FROM log) WHERE p = 1 AND error"))
def failed_keys(spark: SparkSession, d: str) -> DataFrame:
    return L.failed(log(spark, d).select("key", "ts", "event_id", "error"), "key", ["ts", "event_id"])


@query("longest_error_run", over("log", """, r AS (SELECT key, error, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) - row_number() OVER (PARTITION BY key, error ORDER BY ts, event_id) AS g FROM log),
n AS (SELECT key, g, count(*) AS n FROM r WHERE error GROUP BY 1, 2) SELECT key, coalesce(max(n), 0) AS longest, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM (SELECT DISTINCT key FROM log) LEFT JOIN n USING (key) GROUP BY 1"""))
def longest_error_run(spark: SparkSession, d: str) -> DataFrame:
    return L.error_runs(log(spark, d).select("key", "ts", "event_id", "error"), "key", ["ts", "event_id"])


@query("stage_records", over("log", "SELECT key, max(event_id) FILTER (NOT error) AS event_id, count(*) FILTER (NOT error) AS completed FROM log GROUP BY 1 HAVING count(*) FILTER (NOT error) > 1"))
def stage_records(spark: SparkSession, d: str) -> DataFrame:
    """Keys completed more than once beside their latest completed record."""
    last, again = L.stage_records(log(spark, d).select("key", "ts", "event_id", "error"), "key", ["event_id"])
    return last.select("key", "event_id").join(again.withColumnRenamed("n", "completed"), "key")


MERGE = """, f AS (SELECT question_id, convertible, stage, 'first' AS reason FROM corpus), s AS (SELECT question_id, score >= 3 AS convertible, 'rescore' AS stage, 'second' AS reason FROM corpus WHERE question_id % 2 = 0),
m AS (SELECT f.question_id, CASE WHEN NOT f.convertible AND s.question_id IS NOT NULL THEN s.convertible ELSE f.convertible END AS convertible, CASE WHEN NOT f.convertible AND s.question_id IS NOT NULL THEN s.stage ELSE f.stage END AS stage, CASE WHEN NOT f.convertible AND s.question_id IS NOT NULL THEN s.reason ELSE f.reason END AS reason FROM f LEFT JOIN s USING (question_id)),
w AS (SELECT question_id, CASE WHEN question_id % 11 = 0 THEN ' ' ELSE ' q' || question_id || ' ' END AS t, question_id % 13 = 0 AS e FROM corpus WHERE question_id % 17 <> 0),
a AS (SELECT question_id, reason, m.convertible AND NOT coalesce(e, true) AND trim(t) <> '' AS convertible, CASE WHEN m.convertible AND coalesce(e, true) THEN 'rewrite_error' WHEN m.convertible AND trim(t) = '' THEN 'rewrite' ELSE stage END AS stage, CASE WHEN m.convertible AND NOT coalesce(e, true) AND trim(t) <> '' THEN trim(t) END AS open_question FROM m LEFT JOIN w USING (question_id))"""


def _logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, q = corpus(spark, d), F.col("question_id")
    first = c.select("question_id", "convertible", "stage", F.lit("first").alias("reason"))
    second = c.where(q % 2 == 0).select("question_id", (F.col("score") >= 3).alias("convertible"), F.lit("rescore").alias("stage"), F.lit("second").alias("reason"))
    text = F.when(q % 11 == 0, " ").otherwise(F.concat(F.lit(" q"), q.cast("string"), F.lit(" ")))
    return first, second, c.where(q % 17 != 0).select("question_id", text.alias("text"), (q % 13 == 0).alias("error"))


@query("merge_attach", over("corpus", MERGE + " SELECT question_id, convertible, stage, reason, open_question FROM a"))
def merge_attach(spark: SparkSession, d: str) -> DataFrame:
    """L6, L7."""
    first, second, rewrites = _logs(spark, d)
    return L.attached(L.merged(first, second), rewrites)


@query("replayed", over("corpus", MERGE + " SELECT question_id, convertible, stage, reason, open_question FROM a WHERE stage <> 'rewrite_error' AND NOT (question_id % 13 = 0 AND stage = 'x')"))
def replayed(spark: SparkSession, d: str) -> DataFrame:
    """Each log has every record twice, the first time as an error."""
    def twice(df: DataFrame) -> DataFrame:
        own = df.withColumn("error", F.lit(False)) if "error" not in df.columns else df.withColumnRenamed("error", "error_")
        seq = own.withColumns({"error": F.coalesce(F.col("error_"), F.lit(False)) if "error_" in own.columns else F.lit(False), "seq": F.lit(2)})
        return seq.drop("error_").unionByName(seq.drop("error_").withColumns({"error": F.lit(True), "seq": F.lit(1)}))

    first, second, rewrites = _logs(spark, d)
    return L.replayed(twice(first), twice(second), twice(rewrites), "question_id", ["seq"]).select("question_id", "convertible", "stage", "reason", "open_question")


@query("conversion_summary", over("corpus", """, c AS (SELECT *, question_id % 5 = 0 AS list_style FROM corpus) SELECT list_style, count(*) AS decided, count(*) FILTER (convertible) AS kept, count(*) FILTER (NOT convertible AND stage = 'judge') AS dropped_judge, count(*) FILTER (NOT convertible AND stage = 'rescore') AS dropped_rescore,
count(*) FILTER (NOT convertible AND stage = 'rewrite') AS dropped_rewrite, grouping(list_style) AS whole, count(*) FILTER (convertible) / CAST(count(*) AS DOUBLE) AS rate FROM c GROUP BY ROLLUP (list_style)"""))
def conversion_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.conversion_summary(corpus(spark, d).withColumn("list_style", F.col("question_id") % 5 == 0)).withColumn("whole", F.col("whole").cast("long"))


@query("open_corpus", over("corpus", "SELECT question_id, trim(question, ' ') AS question, category, false AS list_style FROM corpus WHERE convertible"))
def open_corpus(spark: SparkSession, d: str) -> DataFrame:
    return L.open_corpus(corpus(spark, d).withColumn("list_style", F.lit(None).cast("boolean")))


@query("decision_records", over("items corpus", "SELECT question_id, items.category, score >= 5 AS convertible, score, stage AS reason, 'i1' AS instrument FROM items JOIN corpus USING (question_id)"))
def decision_records(spark: SparkSession, d: str) -> DataFrame:
    v = corpus(spark, d).select("question_id", "score", "convertible", F.col("stage").alias("reason"))
    return L.decision_records(items(spark, d).select("question_id", "category"), v, "i1")
