"""Queries of scalar expressions, sources and projections (S, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.functions import expr as X
from routecast.functions.text import ascii_key, normal_key
from routecast.operators import reports as R
from routecast.operators.digests import member_digests
from routecast.operators.leaks import leaked
from routecast.plans.views import corpus, forecasts, items, over, read, trials, v_labels
from routecast.registry import query
from routecast.sources import records


@query("levels", over("forecasts", """
SELECT question_id, CAST(least(6 * correct_count // k, 5) AS INT) AS truth_level, CAST(least(floor(probability * 6), 5) AS INT) AS said_level,
  2 * correct_count >= k AS local_truth, probability >= 0.5e0 AS local FROM forecasts"""))
def levels(spark: SparkSession, d: str) -> DataFrame:
    c, k, p = F.col("correct_count"), F.col("k"), F.col("probability")
    return forecasts(spark, d).select("question_id", X.truth_level(c, k).alias("truth_level"), X.probability_level(p).alias("said_level"), X.solvable(c, k).alias("local_truth"), X.routed(p).alias("local"))


@query("wording_flags", r"""
SELECT doc_id, starts_with(lower(trim(text)), 'of ') AS opens, regexp_matches(text, '(?i)\b(?:of the following|of these|following statements|statements above|listed above|options above)\b') AS dangling,
  CASE WHEN regexp_matches(trim(text), '^[-+]?[0-9.,]+$') THEN 'bare_number' WHEN regexp_matches(trim(text), '(?i)^(?:and|or|but|which|that|because|greater|less|more)\b') THEN 'fragment'
    WHEN len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) <= 2 AND length(trim(text)) <= 12 THEN 'very_short' ELSE '' END AS suspect,
  regexp_replace(source, '[^A-Za-z0-9_.-]+', '_', 'g') AS slug, not regexp_matches(text, '[^\s]') AS ungradable,
  CAST(len(list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda x: x <> '')) AS INT) AS words FROM documents""")
def wording_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.lower(F.trim(t)).startswith("of ").alias("opens"), X.dangling(t).alias("dangling"), X.suspect(t).alias("suspect"),
                                              X.slug(F.col("source")).alias("slug"), X.ungradable(t).alias("ungradable"), X.word_count(t).alias("words"))


@query("list_style_items", "SELECT p_partkey AS question_id, p_size % 5 = 0 AS list_style FROM part")
def list_style_items(spark: SparkSession, d: str) -> DataFrame:
    """P5: questions of which those of every fifth size ask for one of a list."""
    text = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("  Which of the following is a "), "p_name")).otherwise(F.concat(F.lit("Which of these is a "), "p_name"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("question_id"), X.list_style(text).alias("list_style"))


@query("answer_leaks", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON length(trim(b.text)) >= 8 AND contains(lower(d.text), lower(trim(b.text)))")
def answer_leaks(spark: SparkSession, d: str) -> DataFrame:
    """P7 over the corpus: benchmark items, of 8 characters or more, whose whole text is in a document, whatever its case.

    See `leaks.leaked`; only texts that may have an item leave the tasks that read them.
    """
    return leaked(read(spark, d, "benchmark").select("item_id", F.col("text").alias("answer")), read(spark, d, "documents").select("doc_id", "text"))


@query("math_delimiters", r"""
WITH x AS (SELECT doc_id, regexp_replace(text, '[$\n]', ' ', 'g') AS x FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(x, '^\s*[^\s\d]') OR (trim(x) <> '' AND regexp_matches(x, '[\\^_=]')) THEN '\(' || x || '\)' ELSE '$' || x || '$' END || ' or $5 and $10' AS text FROM x""")
def math_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts between dollars, before prices."""
    x = F.regexp_replace("text", r"[$\n]", " ")
    return read(spark, d, "documents").select("doc_id", X.math_delimiters(F.concat(F.lit("$"), x, F.lit("$ or $5 and $10"))).alias("text"))


@query("repaired_json", "SELECT doc_id, source AS verdict, text AS reason FROM documents")
def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """Replies that quote whole texts, with escapes before `%`, `&`, `#` and `_` that JSON does not have, are parsed after repair."""
    valid = F.to_json(F.struct(F.col("source").alias("verdict"), F.col("text").alias("reason")), {"ignoreNullFields": "false"})
    r = F.from_json(X.repaired_json(F.regexp_replace(valid, r"(?<!\\)[%&#_]", r"\\$0")), "verdict string, reason string")
    return read(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.verdict", "r.reason")


@query("prompts", over("items", """
SELECT question_id, text || chr(10) || 'A. ' || category || chr(10) || 'B. ' || segment AS prompt, 'A' || CASE WHEN question_id < 1000 THEN lpad(CAST(question_id AS VARCHAR), 3, '0') ELSE CAST(question_id AS VARCHAR) END AS blind_id,
  question_id || ':0' AS key FROM items"""))
def prompts(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return i.select("question_id", X.prompt(F.col("text"), F.array("category", "segment")).alias("prompt"), X.blind_id(F.col("question_id")).alias("blind_id"), X.item_key(F.col("question_id"), F.lit(0)).alias("key"))


BACKGROUND = """
WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'age' WHEN 1 THEN 'education' WHEN 2 THEN 'student' WHEN 3 THEN 'usage' ELSE 'gender' END AS field,
  CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey % 150 AS VARCHAR) WHEN 1 THEN (CASE WHEN c_custkey % 2 = 0 THEN ' Master''s ' ELSE 'school' END) WHEN 2 THEN (CASE WHEN c_custkey % 3 = 0 THEN 'Student' ELSE 'employee' END)
    WHEN 3 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE '' END) ELSE (CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'other' END) END AS raw FROM customer)
SELECT id, field, CASE WHEN trim(raw) = '' THEN 'missing' WHEN field = 'age' THEN (CASE WHEN CAST(raw AS INT) BETWEEN 1 AND 120 THEN 'coded' ELSE 'invalid' END)
    WHEN lower(trim(raw)) IN ('master''s', 'student', 'employee', 'daily', 'female') THEN 'coded' ELSE 'ambiguous' END AS status,
  CASE WHEN field = 'age' THEN (CASE WHEN CAST(raw AS INT) BETWEEN 1 AND 120 THEN CAST(raw AS DOUBLE) END) ELSE CASE lower(trim(raw)) WHEN 'master''s' THEN 2e0 WHEN 'student' THEN 1e0 WHEN 'employee' THEN 0e0 WHEN 'daily' THEN 4e0 WHEN 'female' THEN 0e0 END END AS value FROM r"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    field = F.get(F.array(*[F.lit(x) for x in ("age", "education", "student", "usage", "gender")]), (k % 5).cast("int"))
    raw = F.when(k % 5 == 0, (k % 150).cast("string")).when(k % 5 == 1, F.when(k % 2 == 0, " Master's ").otherwise("school")).when(
        k % 5 == 2, F.when(k % 3 == 0, "Student").otherwise("employee")).when(k % 5 == 3, F.when(k % 2 == 0, "daily").otherwise("")).otherwise(F.when(k % 2 == 0, "Female").otherwise("other"))
    return read(spark, d, "customer").select(k.alias("id"), field.alias("field"), raw.alias("raw"))


@query("background_codes", BACKGROUND)
def background_codes(spark: SparkSession, d: str) -> DataFrame:
    return X.coded_background(_answers(spark, d)).select("id", "field", "status", "value")


@query("background_report", f"""WITH c AS ({BACKGROUND}), n AS (SELECT field, status, count(*) AS n FROM c GROUP BY 1, 2),
q AS (SELECT field, 'coded' AS status, round_even(avg(value), 1) AS mean, round_even(stddev_samp(value), 1) AS sd, round_even(quantile_cont(value, 0.25), 1) AS q1, round_even(quantile_cont(value, 0.5), 1) AS median,
  round_even(quantile_cont(value, 0.75), 1) AS q3, round_even(min(value), 1) AS least, round_even(max(value), 1) AS greatest FROM c WHERE status = 'coded' GROUP BY 1)
SELECT * FROM n LEFT JOIN q USING (field, status)""")
def background_report(spark: SparkSession, d: str) -> DataFrame:
    """Ages and categories of the same answers in one report."""
    return R.background_report(_answers(spark, d))


@query("decode_heads", over("items", """, z AS (SELECT question_id, (question_id % 7 - 3) / 2e0 AS a, (question_id % 5 - 2) / 2e0 AS b FROM items),
s AS (SELECT *, 1 / (1 + exp(-a)) AS sa, 1 / (1 + exp(-b)) AS sb, ln(1 + exp(a)) + 1e-4 AS al, ln(1 + exp(b)) + 1e-4 AS be,
  [a, b, a - b, a + b, -a, -b] AS v FROM z),
e AS (SELECT *, list_transform(v, lambda x: exp(x)) AS w FROM s)
SELECT question_id, sa AS regression, sa AS binomial, al / (al + be) AS beta_binomial,
  (sa + sa * sb + sa * sb * sa + sa * sb * sa * sb + sa * sb * sa * sb * sa) / 5 AS corn,
  (w[2] + 2 * w[3] + 3 * w[4] + 4 * w[5] + 5 * w[6]) / list_sum(w) / 5 AS softmax FROM e"""))
def decode_heads(spark: SparkSession, d: str) -> DataFrame:
    """Five heads on stand-in logits made from ids."""
    a, b = (F.col("question_id") % 7 - 3) / F.lit(2.0), (F.col("question_id") % 5 - 2) / F.lit(2.0)
    z = items(spark, d).select("question_id", F.array(a, b, a, b, a).alias("five"), F.array(a, b, a - b, a + b, -a, -b).alias("six"))
    mean = lambda c, head: X.decoded(F.col(c), head)[0].alias(head)
    return z.select("question_id", mean("five", "regression"), mean("five", "binomial"), mean("five", "beta_binomial"), mean("five", "corn"), mean("six", "softmax"))


@query("valid_pmfs", over("forecasts", "SELECT question_id, correct_count % 4 <> 0 AS valid, k % 3 <> 0 AS consistent FROM forecasts"))
def valid_pmfs(spark: SparkSession, d: str) -> DataFrame:
    """The binomial head's distribution, with its first share lost where the count divides by 4, and a mean, stored too large where the trials divide by 3."""
    p = F.greatest(F.least(F.col("probability"), F.lit(0.9)), F.lit(0.1))
    f = forecasts(spark, d).select("question_id", "correct_count", F.array(F.ln(p / (1 - p))).alias("logits"), p.alias("p"), F.when(F.col("k") % 3 == 0, p + 0.01).otherwise(p).alias("stored"))
    _, pmf = X.decoded(F.col("logits"), "binomial")
    broken = F.when(F.col("correct_count") % 4 == 0, F.transform(pmf, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x))).otherwise(pmf)
    return f.select("question_id", X.valid_pmf(broken, F.col("p")).alias("valid"), X.consistent(F.col("stored"), F.col("logits"), "binomial").alias("consistent"))


@query("strata", over("corpus", """
SELECT question_id, CASE WHEN score BETWEEN 4 AND 7 THEN 'borderline' WHEN convertible THEN CASE WHEN stage = 'judge' THEN 'kept_judge' ELSE 'kept_rescore' END
  ELSE CASE WHEN stage = 'rewrite' THEN 'drop_rewrite' ELSE 'drop_rescore' END END AS stratum FROM corpus"""))
def strata(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("question_id", X.stratum(F.col("score"), F.col("convertible"), F.col("stage")).alias("stratum"))


@query("scaled_tokens", over("trials", "SELECT question_id, avg(output_tokens) AS mean_tokens, CAST(floor(avg(output_tokens) * 0.5e0 + 0.5e0) AS BIGINT) AS half, max(output_tokens) >= 400 AS capped FROM trials GROUP BY 1"))
def scaled_tokens(spark: SparkSession, d: str) -> DataFrame:
    g = trials(spark, d).groupBy("question_id").agg(F.avg("output_tokens").alias("mean_tokens"), F.max("output_tokens").alias("m"))
    return g.select("question_id", "mean_tokens", X.scaled_tokens(F.col("mean_tokens"), 0.5).alias("half"), X.capped(F.col("m")).alias("capped"))


@query("strict_parses", """
WITH x AS (SELECT o_orderkey, unnest(['status', 'priority', 'key', 'customer', 'price', 'large']) AS field, unnest([o_orderstatus, left(o_orderpriority, 1), '0' || o_orderkey, CAST(o_custkey AS VARCHAR), NULL, NULL]) AS raw,
  o_totalprice > 150000 AS large FROM orders)
SELECT o_orderkey, field, CASE WHEN field = 'large' THEN CASE WHEN large THEN true WHEN o_orderkey % 2 = 0 THEN false END END AS flag,
  CASE WHEN field IN ('priority', 'customer') THEN CAST(raw AS BIGINT) END AS number FROM x""")
def strict_parses(spark: SparkSession, d: str) -> DataFrame:
    """Texts of several columns read as truth values and as whole numbers."""
    large = F.col("o_totalprice") > 150000
    texts = {"status": F.col("o_orderstatus"), "priority": F.substring("o_orderpriority", 1, 1), "key": F.concat(F.lit("0"), F.col("o_orderkey").cast("string")), "customer": F.col("o_custkey").cast("string"),
             "price": F.format_string("%.2f", "o_totalprice"), "large": F.when(large, "TRUE").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "False").otherwise("false"))}
    rows = read(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), t.alias("raw")) for k, t in texts.items()])).alias("x")).select("o_orderkey", "x.*")
    return rows.select("o_orderkey", "field", X.strict_bool(F.col("raw")).alias("flag"), X.strict_int(F.col("raw")).alias("number"))


@query("normalised_keys", r"SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS key FROM documents")
def normalised_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", ascii_key(F.col("text")).alias("key"))


@query("unicode_keys", r"SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS key FROM documents")
def unicode_keys(spark: SparkSession, d: str) -> DataFrame:
    """P10 with NFKC and case folding. SQL says it for the letters of these tables; tests compare others with Python's."""
    return read(spark, d, "documents").select("doc_id", normal_key(F.col("text")).alias("key"))


@query("reversed_votes", """
SELECT doc_id, 'R' || (doc_id % 3) AS rater, 'quality' AS field, CASE WHEN doc_id % 3 = 1 THEN CASE quality WHEN 1 THEN 'no' ELSE 'yes' END ELSE CASE quality WHEN 1 THEN 'yes' ELSE 'no' END END AS vote, doc_id % 3 = 1 AS reversed FROM labels""")
def reversed_votes(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "labels").select("doc_id", F.concat(F.lit("R"), (F.col("doc_id") % 3).cast("string")).alias("rater"), F.lit("quality").alias("field"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("vote"))
    return X.reversed_votes(v, spark.createDataFrame([("R1", "quality")], "rater string, field string"))


@query("nested_answers", over("trials", "SELECT question_id, rep, 'a' || rep AS response, invalid, success FROM trials"))
def nested_answers(spark: SparkSession, d: str) -> DataFrame:
    """Nested evaluation rows built from the trials and projected back."""
    t = trials(spark, d)
    text = F.concat(F.lit("a"), F.col("rep").cast("string"))
    n = t.select(F.struct("question_id", "rep").alias("doc"), F.when(F.col("rep") % 2 == 0, F.to_json(F.array(F.array(text)))).otherwise(F.to_json(F.array(text))).alias("resps"),
                 F.to_json(F.array(F.when(F.col("invalid"), "[invalid]").otherwise(text))).alias("filtered_resps"), F.col("success").cast("double").alias("exact_match"))
    return records.nested_answers(n)


@query("answer_texts", over("items", "SELECT question_id, CASE question_id % 4 WHEN 0 THEN category WHEN 1 THEN segment WHEN 2 THEN text END AS answer_text FROM items"))
def answer_texts(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return i.select("question_id", records.answer_text(F.array("category", "segment", "text"), (F.col("question_id") % 4).cast("int")).alias("answer_text"))


@query("panel_fingerprints", over("trials", """
, h AS (SELECT rep, CAST('0x' || left(md5(concat_ws(chr(31), question_id, output_tokens)), 15) AS BIGINT) AS h FROM trials)
SELECT rep, count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h GROUP BY rep"""))
def panel_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from routecast.operators.checks import fingerprint

    t = trials(spark, d)
    return fingerprint(t, ["rep"], F.concat_ws("\x1f", F.col("question_id").cast("string"), F.col("output_tokens").cast("string")))


@query("item_identity", over("items", "SELECT category, count(*) AS n, sha256('[' || string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) || ']') AS identity FROM items GROUP BY 1"))
def item_identity(spark: SparkSession, d: str) -> DataFrame:
    return member_digests(items(spark, d), "category", "question_id", "n", "identity")


@query("label_counts", over("v_labels", "SELECT question_id, correct_count, invalid_count, k FROM v_labels"))
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return v_labels(spark, d)
