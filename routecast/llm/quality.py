"""Host-level quality rules with shrunk failure rates (operator 4), in DataFrame functions only.

Each document is measured inside its own row. Hosts (column `source`; null is a host too) get
failure counts per rule by a plain aggregate, rates are shrunk with a beta prior fitted to all hosts by
moments, and the verdict of a host comes back by a join on (host, salt), so that one host may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, own_columns, words_of

SPAN = 8
#: Rule name and condition on the measures; the first two are the base rules.
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}


def _repeat_words(df: DataFrame, words: str) -> DataFrame:
    """Adds n_repeat_words: words covered by SPAN-word windows that occur twice or more in the row's `words`.

    Window hashes are sorted with their places only in rows where some hash occurs twice; equal
    neighbours give the places, and the gaps between places give the words covered.
    """
    at = F.sequence(F.lit(0), F.size(words) - SPAN)
    h = F.when(F.size(words) >= SPAN, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SPAN)])))
    df = df.withColumn("_h", h)
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_s", F.when(twice, placed))

    def met(e: Column, j: Column) -> Column:
        s = F.col("_s")
        same = F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False))
        return F.when(same, e["i"])

    df = df.withColumn("_p", F.sort_array(F.filter(F.transform("_s", met), lambda i: i.isNotNull())))
    p = F.col("_p")
    gaps = F.transform(p, lambda i, j: F.least(F.lit(SPAN), F.coalesce(F.get(p, j + 1) - i, F.lit(SPAN))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_h", "_s", "_p")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each whole text (null: no words), one row per document."""
    d = own_columns(docs, "doc_id", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns({"_w": words_of(F.col("text")), "_l": lines})
    d = d.select(
        "doc_id", "source", "_w", F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    return _repeat_words(d, "_w").drop("_w")


def host_verdicts(measured: DataFrame, limit: float = 0.5) -> DataFrame:
    """source, n, the shrunk rate of each rule and `bad`: some rate is above `limit`.

    The prior of a rule is beta(m s, (1 - m) s): m is the mean of the hosts' rates, and s = m (1 - m) / v - 1 from their
    variance v, held between 1 and 10000; with one host or v = 0 it is 10000, so every host gets nearly m.
    """
    hosts = cut(measured.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(c)).alias(r) for r, c in RULES.items()]))
    moments = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    rates = []
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        s = min(10_000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 10_000.0
        rates.append(((F.col(r) + F.lit(m * s)) / (F.col("n") + F.lit(s))).alias(f"rate_{r}"))
    out = hosts.select("source", "n", *rates)
    return out.withColumn("bad", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > limit)


def judge(docs: DataFrame, limit: float = 0.5, salts: int = 16) -> DataFrame:
    """doc_id, the measures, base_failed and kept, one row per document.

    A document that fails a base rule is not kept; any other is kept unless its host is bad. Repeated rows and null ids
    stay; documents with a null source are judged as one host; an empty table gives no row.
    """
    measured = cut(measures(docs))
    bad = host_verdicts(measured, limit).where("bad").select(F.col("source").alias("_host"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    m = measured.withColumn("_own", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    m = m.join(bad, m["source"].eqNullSafe(bad["_host"]) & (m["_own"] == bad["_salt"]), "left")
    failed = F.expr(f"({RULES['few_words']}) or ({RULES['repeats']})")
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    (~failed & F.col("_salt").isNull()).alias("kept"))


def op4_quality(docs: DataFrame) -> DataFrame:
    """`judge` of all documents: null and empty texts fail the base rules, repeated rows keep a row each, an empty table gives no row."""
    return judge(docs)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, sum(k) AS n FROM (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS k FROM p) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN n USING (r)),
f AS (SELECT *, unnest([{'k': 1, 'f': n_words < 20}, {'k': 2, 'f': 100 * n_repeat_words > 30 * n_words},
  {'k': 3, 'f': 10 * n_symbols > 3 * word_chars}, {'k': 4, 'f': 100 * n_dup_lines > 30 * n_lines}]) AS u FROM m),
h AS (SELECT source, u.k AS k, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (u.f) AS DOUBLE) AS x FROM f GROUP BY ALL),
q AS (SELECT k, avg(x / n) AS m, var_pop(x / n) AS v FROM h GROUP BY k),
s AS (SELECT k, m, CASE WHEN v > 0 THEN least(1e4, greatest(1e0, m * (1 - m) / v - 1)) ELSE 1e4 END AS s FROM q),
b AS (SELECT DISTINCT source FROM h JOIN s USING (k) WHERE (x + m * s) / (n + s) > 0.5e0),
a AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM a.source) AS kept FROM a
"""
