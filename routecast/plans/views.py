"""Deterministic study views over the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trials(spark: SparkSession, d: str) -> DataFrame:
    """One row per answer: question_id, rep, success, invalid, output_tokens, model."""
    t = read(spark, d, "lineitem")
    return t.select(F.col("l_partkey").alias("question_id"), F.col("l_linenumber").alias("rep"), (F.col("l_linestatus") == "O").alias("success"),
                    (F.col("l_returnflag") == "A").alias("invalid"), (F.col("l_quantity").cast("int") * 10).alias("output_tokens"), (F.col("l_suppkey") % 3).alias("model"))


def v_labels(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).groupBy("question_id").agg(F.count_if("success").alias("correct_count"), F.count_if("invalid").alias("invalid_count"), F.count(F.lit(1)).alias("k"))


def items(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("segment"),
                    (F.col("p_size") % 5 == 0).alias("list_style"), F.col("p_name").alias("text"))


def probability(multiplier: int = 37) -> Column:
    """The stand-in forecast of a question: a fixed residue over 100."""
    return ((F.col("question_id") * multiplier) % 101).cast("double") / F.lit(100).cast("double")


def forecasts(spark: SparkSession, d: str, multiplier: int = 37) -> DataFrame:
    """Labels with category, list_style and a forecast `probability`."""
    return v_labels(spark, d).join(items(spark, d), "question_id").withColumn("probability", probability(multiplier))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """key, judge, verdict: one per (key, judge).

    What the judges (remainders -2 to 2, or none) said of an answer is gathered as bits of one number, three to a judge in the order of their names: texts would be sorted whole, with a row for each judge.
    """
    t = read(spark, d, "lineitem")
    judges, said = ["J-2", "J-1", "J0", "J1", "J2", None], ["match", "no_answer", "no_match"]
    judge, verdict = F.coalesce(F.col("l_suppkey") % 3 + 2, F.lit(5)), F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 2).otherwise(1)
    # an answer without a question or a repeat has no key
    q, rep = F.when(F.col("l_linenumber").isNotNull(), F.col("l_partkey")), F.when(F.col("l_partkey").isNotNull(), F.col("l_linenumber"))
    g = t.groupBy(q.alias("q"), rep.alias("rep")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (3 * judge + verdict).cast("int"))).alias("bits"))
    least = [F.coalesce(*[F.when(F.col("bits").bitwiseAND(1 << 3 * i + j) != 0, v) for j, v in enumerate(said)]).alias("verdict") for i in range(len(judges))]
    each = F.filter(F.array(*[F.struct(F.lit(j).cast("string").alias("judge"), v) for j, v in zip(judges, least)]), lambda x: x["verdict"].isNotNull())
    return g.select(F.concat(F.col("q").cast("string"), F.lit(":"), F.col("rep").cast("string")).alias("key"), F.inline(each))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """prompt, rater, rating_level, response_time_ms: one per (prompt, rater)."""
    t = read(spark, d, "lineitem")
    return t.groupBy(F.col("l_partkey").alias("prompt"), (F.col("l_suppkey") % 30).alias("rater")).agg(
        F.min(F.col("l_quantity").cast("int") % 6).alias("rating_level"), F.min(F.col("l_extendedprice").cast("long")).alias("response_time_ms"))


def split(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("question_id") % 10
    return items(spark, d).select("question_id", F.when(i <= 1, "test").when(i == 2, "validation").otherwise("train").alias("split"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """question_id, question, category, score, convertible, stage of the documents as a converted corpus."""
    t = read(spark, d, "documents")
    score = (F.col("n_chars") % 10 + 1).cast("int")
    stage = F.when(F.col("doc_id") % 3 == 0, "judge").when(F.col("doc_id") % 3 == 1, "rescore").otherwise("rewrite")
    return t.select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"), F.col("source").alias("category"), score.alias("score"), (score >= 5).alias("convertible"), stage.alias("stage"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """Append-only log: key, seq (ts, event_id), error flag and value."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") == "error").alias("error"), "event_type", "value", "props")


def counters(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("domain"), "ts", "event_id", F.floor(F.col("value") * 100).cast("long").alias("value"), F.lit(1_000_000).cast("long").alias("max_range"))


def participants(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("participant_id"), (18 + F.col("c_custkey") % 60).alias("age"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("outcome"))


SQL: dict[str, str] = {
    "trials": "SELECT l_partkey AS question_id, l_linenumber AS rep, l_linestatus = 'O' AS success, l_returnflag = 'A' AS invalid, CAST(trunc(l_quantity) AS INT) * 10 AS output_tokens, l_suppkey % 3 AS model FROM lineitem",
    "v_labels": "SELECT question_id, count(*) FILTER (success) AS correct_count, count(*) FILTER (invalid) AS invalid_count, count(*) AS k FROM trials GROUP BY 1",
    "items": "SELECT p_partkey AS question_id, p_type AS category, p_brand AS segment, p_size % 5 = 0 AS list_style, p_name AS text FROM part",
    "forecasts": "SELECT *, CAST((question_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS probability FROM v_labels JOIN items USING (question_id)",
    "forecasts53": "SELECT *, CAST((question_id * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS probability FROM v_labels JOIN items USING (question_id)",
    "verdicts": "SELECT l_partkey || ':' || l_linenumber AS key, 'J' || (l_suppkey % 3) AS judge, min(CASE l_returnflag WHEN 'N' THEN 'match' WHEN 'R' THEN 'no_match' ELSE 'no_answer' END) AS verdict FROM lineitem GROUP BY 1, 2",
    "ratings": "SELECT l_partkey AS prompt, l_suppkey % 30 AS rater, min(CAST(trunc(l_quantity) AS INT) % 6) AS rating_level, min(CAST(trunc(l_extendedprice) AS BIGINT)) AS response_time_ms FROM lineitem GROUP BY 1, 2",
    "split": "SELECT question_id, CASE WHEN question_id % 10 <= 1 THEN 'test' WHEN question_id % 10 = 2 THEN 'validation' ELSE 'train' END AS split FROM items",
    "corpus": "SELECT doc_id AS question_id, text AS question, source AS category, CAST(n_chars % 10 + 1 AS INT) AS score, n_chars % 10 + 1 >= 5 AS convertible, CASE doc_id % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'rescore' ELSE 'rewrite' END AS stage FROM documents",
    "log": "SELECT user_id AS key, ts, event_id, event_type = 'error' AS error, event_type, value, props FROM events",
    "counters": "SELECT user_id AS domain, ts, event_id, CAST(floor(value * 100e0) AS BIGINT) AS value, CAST(1000000 AS BIGINT) AS max_range FROM events",
    "participants": "SELECT c_custkey AS participant_id, 18 + c_custkey % 60 AS age, c_mktsegment AS segment, c_acctbal AS outcome FROM customer",
}
_NEEDS = {"v_labels": ["trials"], "forecasts": ["v_labels", "items"], "forecasts53": ["v_labels", "items"], "split": ["items"]}


def majority_sql(vote: str) -> str:
    """The aggregate `panel.majority` of a column of votes."""
    need = "greatest(2, count(*) // 2 + 1)"
    return f"CASE WHEN count(*) FILTER ({vote} = 'yes') >= {need} THEN true WHEN count(*) FILTER ({vote} = 'no') >= {need} THEN false END"


def ctes(*names: str) -> str:
    """`WITH` and the definitions of the named views and of those they need, with a comma at the end."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + ", "


def over(names: str, body: str) -> str:
    """A query `body` over the named views (space-separated)."""
    return ctes(*names.split())[:-2] + " " + body
