"""Queries of sampling, assignment and families (D, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.functions.expr import truth_level
from routecast.operators import families as FM
from routecast.operators import sampling as S
from routecast.plans.views import corpus, items, over, ratings, read, split, v_labels
from routecast.registry import query
from routecast.sources.shared import written

LEVELLED = ", lv AS (SELECT question_id, category, CAST(least(6 * correct_count // k, 5) AS INT) AS level FROM v_labels JOIN items USING (question_id))"


def _levelled(spark: SparkSession, d: str) -> DataFrame:
    return v_labels(spark, d).join(items(spark, d), "question_id").select("question_id", "category", truth_level(F.col("correct_count"), F.col("k")).alias("level"))


@query("split_restriction", over("items split", "SELECT question_id, category FROM items JOIN split USING (question_id) WHERE split = 'validation'"))
def split_restriction(spark: SparkSession, d: str) -> DataFrame:
    return S.restricted(items(spark, d), split(spark, d), "validation")[0].select("question_id", "category")


@query("allocation", over("v_labels items", LEVELLED + ", p AS (SELECT category, level, count(*) AS pool FROM lv GROUP BY 1, 2) SELECT c.category, CAST(l.v AS INT) AS level, CAST(coalesce(pool, 0) AS INT) AS pool, CAST([3, 3, 4, 4, 3, 3][l.v + 1] AS INT) AS target FROM (SELECT DISTINCT category FROM p) c CROSS JOIN range(6) l(v) LEFT JOIN p ON p.category = c.category AND p.level = l.v"))
def allocation(spark: SparkSession, d: str) -> DataFrame:
    """Targets and pools; the order-dependent takes are tested against a plain loop."""
    pools = _levelled(spark, d).groupBy("category", "level").agg(F.count(F.lit(1)).alias("pool"))
    return S.allocation(pools, 20).select("category", "level", "pool", "target")


def takes_sql(per_category: int) -> str:
    """CTEs from `p` (category, level, pool) to `tk` (category, take list, pool list): one CTE a band."""
    n = S.LEVELS
    pools = ", ".join(f"coalesce(sum(pool) FILTER (level = {b}), 0)::BIGINT" for b in range(n))
    out = f", t0 AS (SELECT category, [{pools}] AS pool, {S.band_targets(per_category)}::BIGINT[] AS take FROM p GROUP BY category)"
    for b, ranks in enumerate(S.donor_ranks()):
        room = lambda d: f"greatest(0, pool[{d + 1}] - take[{d + 1}])"
        lack = f"greatest(0, take[{b + 1}] - pool[{b + 1}])"
        new = []
        for d in range(n):
            better = " - ".join([lack, *[room(o) for o in range(n) if o != b and ranks[o] < ranks[d]]])
            new.append(f"take[{d + 1}] - {lack}" if d == b else f"take[{d + 1}] + greatest(0, least({room(d)}, {better}))")
        out += f", t{b + 1} AS (SELECT category, pool, [{', '.join(new)}]::BIGINT[] AS take FROM t{b})"
    return out + f", tk AS (SELECT category, pool, CASE WHEN list_sum(take) = {per_category} THEN take END AS take FROM t{n})"


POOLS = LEVELLED + ", p AS (SELECT category, level, count(*) AS pool FROM lv GROUP BY 1, 2)"


@query("allocation_takes", over("v_labels items", POOLS + takes_sql(20) + " SELECT category, CAST(v AS INT) AS level, [3, 3, 4, 4, 3, 3][v + 1] AS target, CAST(take[v + 1] AS INT) AS take, CAST(pool[v + 1] AS INT) AS pool FROM tk, range(6) l(v)"))
def allocation_takes(spark: SparkSession, d: str) -> DataFrame:
    """D3 whole."""
    return S.allocation(_levelled(spark, d).groupBy("category", "level").agg(F.count(F.lit(1)).alias("pool")), 20)


@query("stratified_draw", over("v_labels items", LEVELLED + """, o AS (SELECT *, row_number() OVER (PARTITION BY category, level ORDER BY md5(concat_ws(':', '7', category, question_id)), question_id) AS place FROM lv WHERE level IN (2, 3))
SELECT question_id, category, level FROM o WHERE place = 1"""))
def stratified_draw(spark: SparkSession, d: str) -> DataFrame:
    """D4 with two items a category: D2 gives them to the middle bands, so SQL can say the takes."""
    return S.stratified_draw(_levelled(spark, d), 2, 7).select("question_id", "category", "level")


@query("stratified_draw_full", over("v_labels items", POOLS + takes_sql(20) + """, o AS (SELECT *, row_number() OVER (PARTITION BY category, level ORDER BY md5(concat_ws(':', '7', category, question_id)), question_id) AS place FROM lv)
SELECT question_id, category, level FROM o JOIN tk USING (category) WHERE place <= take[level + 1]"""))
def stratified_draw_full(spark: SparkSession, d: str) -> DataFrame:
    """D4 with twenty items a category and the sequential donors of D3."""
    return S.stratified_draw(_levelled(spark, d), 20, 7).select("question_id", "category", "level")


@query("sqrt_allocation", over("corpus", """, p AS (SELECT CASE WHEN score BETWEEN 4 AND 7 THEN 'borderline' ELSE stage END AS stratum, count(*) AS population FROM corpus GROUP BY 1),
s AS (SELECT greatest(0, 200 - (SELECT least(50, population) FROM p WHERE stratum = 'borderline')) / (SELECT sum(sqrt(population)) FROM p WHERE stratum <> 'borderline') AS scale)
SELECT stratum, population, CAST(least(CASE WHEN stratum = 'borderline' THEN 50 ELSE greatest(12, round_even(sqrt(population) * scale, 0)) END, population) AS BIGINT) AS draw FROM p, s"""))
def sqrt_allocation(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("score").between(4, 7), "borderline").otherwise(F.col("stage"))
    return S.sqrt_allocation(corpus(spark, d).groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("population")), 200)


@query("blind_sample", over("corpus", """, o AS (SELECT question_id, stage AS stratum, row_number() OVER (PARTITION BY stage ORDER BY md5(concat_ws(':', '3', stage, question_id)), question_id) AS p FROM corpus), s AS (SELECT question_id, stratum FROM o WHERE p <= 30)
SELECT question_id, stratum, CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '3', 'blind', question_id)), question_id) AS INT) AS place, 'A' || lpad(CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '3', 'blind', question_id)), question_id) AS VARCHAR), 3, '0') AS blind_id FROM s"""))
def blind_sample(spark: SparkSession, d: str) -> DataFrame:
    """D6."""
    c = corpus(spark, d).select("question_id", F.col("stage").alias("stratum"))
    return S.stratified_sample(c, c.select("stratum").distinct().withColumn("draw", F.lit(30)), 3, "question_id")


QUOTA = """, r AS (SELECT doc_id AS key, n_chars AS length, source AS category, doc_id % 3 = 0 AS list_style FROM documents), a AS (SELECT key, 'shortest' AS quota FROM r ORDER BY length, key LIMIT 15),
b AS (SELECT key, 'longest' AS quota FROM r WHERE key NOT IN (SELECT key FROM a) ORDER BY length DESC, key LIMIT 10), c AS (SELECT key, 'flagged' AS quota FROM r WHERE list_style AND key NOT IN (SELECT key FROM a UNION ALL SELECT key FROM b) ORDER BY md5(concat_ws(':', '5', key)), key LIMIT 5),
x AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), e AS (SELECT key, 'category' AS quota FROM (SELECT key, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws(':', '5', key)), key) AS p FROM r WHERE key NOT IN (SELECT key FROM x)) WHERE p <= 2),
y AS (SELECT * FROM x UNION ALL SELECT * FROM e), f AS (SELECT key, 'fill' AS quota FROM r WHERE key NOT IN (SELECT key FROM y) ORDER BY md5(concat_ws(':', '5', key)), key LIMIT 30)"""


@query("priority_sample", "WITH z AS (SELECT 1)" + QUOTA + " SELECT * FROM y UNION ALL SELECT * FROM f")
def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("length"), F.col("source").alias("category"), (F.col("doc_id") % 3 == 0).alias("list_style"))
    return S.priority_sample(t, 5, per_category=2, total=100)


# 20 prompts a category by the seeded draw of D4, over the whole table.
DRAWN = POOLS + takes_sql(20) + """, o AS (SELECT *, row_number() OVER (PARTITION BY category, level ORDER BY md5(concat_ws(':', '7', category, question_id)), question_id) AS place FROM lv),
dr AS (SELECT category, question_id AS prompt_id FROM o JOIN tk USING (category) WHERE place <= take[level + 1])"""
ASSIGN = DRAWN + """, q AS (SELECT category, prompt_id, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws(':', '9', 'item', category, prompt_id)), prompt_id) - 1 AS item FROM dr),
w AS (SELECT category, v AS participant, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws(':', '9', 'rater', category, v)), v) - 1 AS place FROM (SELECT DISTINCT category FROM q), range(30) t(v)),
s AS (SELECT category, prompt_id, item + r.v * 20 AS slot FROM q, range(3) r(v)), g AS (SELECT CAST(participant AS INT) AS participant, prompt_id, category FROM s JOIN w USING (category) WHERE place = slot // 2)"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    prompts = S.stratified_draw(_levelled(spark, d), 20, 7).select("category", F.col("question_id").alias("prompt_id"))
    return S.assignment(prompts, 9, participants=30, raters=3, per_participant=2)[0]


@query("rater_assignment", over("v_labels items", ASSIGN + " SELECT * FROM g"))
def rater_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


@query("participant_order", over("v_labels items", ASSIGN + """, po AS (SELECT participant, CAST(prompt_id AS VARCHAR) AS prompt_id, category, CAST(row_number() OVER (PARTITION BY participant ORDER BY md5(concat_ws(':', '9', participant, prompt_id)), prompt_id) AS DOUBLE) AS pos FROM g),
n AS (SELECT participant, count(*) AS n FROM g GROUP BY 1), u AS (SELECT * FROM po UNION ALL SELECT participant, 'ATT-' || participant, 'attention', CAST('0x' || left(md5(concat_ws(':', '9', 'attention', participant)), 8) AS BIGINT) % n + 1.5e0 FROM n)
SELECT participant, CAST(row_number() OVER (PARTITION BY participant ORDER BY pos) AS INT) AS position, prompt_id, category FROM u"""))
def participant_order(spark: SparkSession, d: str) -> DataFrame:
    return S.participant_order(_assigned(spark, d).withColumn("prompt_id", F.col("prompt_id").cast("string")), 9)


@query("prompt_texts", over("items", "SELECT question_id, category, text || ' for $5' AS prompt_text, false AS changed FROM items WHERE question_id % 3 > 0"))
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """Items with a text, prices left as they are."""
    i = items(spark, d)
    texts = i.select("question_id", F.when(F.col("question_id") % 3 > 0, F.concat("text", F.lit(" for $5"))).alias("text"))
    return S.with_texts(i.select("question_id", "category"), texts)[0]


@query("packages", over("corpus", "SELECT question_id, annotator, row_number() OVER (PARTITION BY annotator ORDER BY md5(concat_ws(':', '4', annotator, question_id)), question_id) AS place FROM (SELECT question_id FROM corpus), (VALUES ('ann'), ('bo'), ('cy')) a(annotator)"))
def packages(spark: SparkSession, d: str) -> DataFrame:
    return S.packages(corpus(spark, d).select("question_id"), ["ann", "bo", "cy"], 4, "question_id")


@query("design_check", over("v_labels items", ASSIGN + " SELECT rule, found, wanted FROM (SELECT unnest([{'rule': 'prompts', 'found': count(DISTINCT prompt_id), 'wanted': 280}, {'rule': 'categories', 'found': count(DISTINCT category), 'wanted': 14}, {'rule': 'participants', 'found': count(DISTINCT participant), 'wanted': 30}], recursive := true) FROM g) WHERE found <> wanted"))
def design_check(spark: SparkSession, d: str) -> DataFrame:
    """D12."""
    return S.design_faults(_assigned(spark, d), 280, 14, 30, 12)


@query("seeded_limit", "SELECT doc_id FROM documents ORDER BY md5(concat_ws(':', '1', doc_id)), doc_id LIMIT 50")
def seeded_limit(spark: SparkSession, d: str) -> DataFrame:
    return S.seeded_limit(read(spark, d, "documents").select("doc_id"), 50, 1, "doc_id")


# Two texts of a document: as it is, and converted (every line once, blank ones left out). P10 in SQL, for texts without characters that only NFKC or case folding change; tests hold others against Python's.
_P10 = r"trim(regexp_replace(replace(lower(nfc_normalize(%s)), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
_ONCE = f"array_to_string(list_filter({_LINES}, lambda x, i: list_position({_LINES}, x) = i), chr(10))"
KEYS = f"t AS (SELECT doc_id, {_P10 % 'text'} AS k1, {_P10 % _ONCE} AS k2 FROM documents)"
FAMILIES = f"""WITH RECURSIVE {KEYS}, e AS (SELECT doc_id, 'a' || k1 AS v FROM t WHERE k1 <> '' UNION ALL SELECT doc_id, 'b' || k2 FROM t WHERE k2 <> ''),
h AS (SELECT v, min(doc_id) AS hub FROM e GROUP BY 1), n AS (SELECT doc_id AS a, hub AS b FROM e JOIN h USING (v) UNION SELECT hub, doc_id FROM e JOIN h USING (v)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), f AS (SELECT a AS doc_id, min(b) AS family FROM r GROUP BY 1)"""


def _two_texts(spark: SparkSession, d: str) -> DataFrame:
    """Only a text with repeated lines is converted: blank lines alone change no key."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    once = F.array_distinct(lines)
    return read(spark, d, "documents").select("doc_id", "text", F.when(F.size(once) == F.size(lines), F.col("text")).otherwise(F.array_join(once, "\n")).alias("converted"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    return FM.families(_two_texts(spark, d), "doc_id", ["text", "converted"])


@query("text_links", f"WITH {KEYS}, h AS (SELECT k1, min(doc_id) AS hub FROM t WHERE k1 <> '' GROUP BY 1) SELECT doc_id AS id, hub FROM t JOIN h USING (k1) WHERE doc_id <> hub")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    return FM.text_links(read(spark, d, "documents"), "doc_id", "text")


@query("families", FAMILIES + " SELECT * FROM f")
def families(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d)


@query("family_ids", FAMILIES + " SELECT family, count(*) AS size, sha256('[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) || ']') AS family_id FROM f GROUP BY 1")
def family_ids(spark: SparkSession, d: str) -> DataFrame:
    return FM.family_ids(_families(spark, d), "doc_id")


@query("leak_free_split", FAMILIES + ", p AS (SELECT DISTINCT family FROM f WHERE doc_id % 10 <= 1) SELECT doc_id, family FROM f WHERE doc_id % 10 > 1 AND family NOT IN (SELECT family FROM p)")
def leak_free_split(spark: SparkSession, d: str) -> DataFrame:
    """documents of the development part that share no family with a test document."""
    f = written(_families(spark, d))
    return FM.unprotected(f.where("doc_id % 10 > 1").select("doc_id"), f, f.where("doc_id % 10 <= 1"), "doc_id").select("doc_id", "family")


@query("family_crossings", FAMILIES + ", s AS (SELECT family, CASE WHEN doc_id % 10 <= 1 THEN 'test' WHEN doc_id % 10 = 2 THEN 'validation' ELSE 'train' END AS split FROM f) SELECT family, count(DISTINCT split) AS roles FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def family_crossings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 10
    return FM.crossings(_families(spark, d).withColumn("split", F.when(i <= 1, "test").when(i == 2, "validation").otherwise("train")))


@query("development_table", over("items v_labels split", "SELECT question_id, question_id AS family, text, correct_count, k, category, split FROM items JOIN v_labels USING (question_id) JOIN split USING (question_id) WHERE split <> 'test'"))
def development_table(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    s = split(spark, d).where("split <> 'test'")
    eligible = s.select("question_id", F.col("question_id").alias("family"))
    return FM.development_table(eligible, i.select("question_id", "text"), v_labels(spark, d).select("question_id", "correct_count", "k"), i.select("question_id", "category"), s)


@query("role_histogram", over("items split", "SELECT split, category, count(*) AS n FROM items JOIN split USING (question_id) GROUP BY GROUPING SETS ((split, category), (split), ())"))
def role_histogram(spark: SparkSession, d: str) -> DataFrame:
    return FM.role_histogram(items(spark, d).join(split(spark, d), "question_id"))


@query("normalised_families", f"WITH RECURSIVE {KEYS} SELECT doc_id, min(doc_id) OVER (PARTITION BY k1) AS family FROM t")
def normalised_families(spark: SparkSession, d: str) -> DataFrame:
    """P10 and F2 on one text."""
    return FM.families(read(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"])


@query("design_pairs", over("ratings", "SELECT prompt, count(DISTINCT rater) AS raters FROM ratings GROUP BY 1"))
def design_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ratings(spark, d).groupBy("prompt").agg(F.count_distinct("rater").alias("raters"))
