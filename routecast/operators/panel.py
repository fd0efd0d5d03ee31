"""Repeated-trial labels and judge panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def success_counts(trials: DataFrame, key: str = "question_id") -> DataFrame:
    """correct_count, invalid_count and k per item."""
    return trials.groupBy(key).agg(F.count_if("success").alias("correct_count"), F.count_if("invalid").alias("invalid_count"), F.count(F.lit(1)).alias("k"))


def with_reference(answers: DataFrame, references: DataFrame, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(answers beside their reference, answers without one)."""
    return answers.join(references, key), answers.join(references, key, "left_anti")


def panel(verdicts: DataFrame, judges: int = 3, keys: DataFrame | None = None, one_each: bool = False) -> tuple[DataFrame, DataFrame]:
    """(panel, keys lacking a judge). Two `match` verdicts make an answer correct; `unanimous` is on the three-way verdict.

    `keys` restricts to a subset by a semi join. One aggregate on the key serves completeness and reduction. `one_each` tells that no key has two rows of a judge, so
    judges are counted without being made distinct, which would take a row for each judge through two more aggregates.
    """
    v = verdicts if keys is None else verdicts.join(keys, "key", "left_semi")
    g = v.groupBy("key").agg(
        (F.count("judge") if one_each else F.count_distinct("judge")).alias("judges"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "match").alias("n_match"),
        F.count_if(F.col("verdict") == "no_answer").alias("n_no_answer"), F.count_if(F.col("verdict") == "no_match").alias("n_no_match"),
        (F.min("verdict") == F.max("verdict")).alias("unanimous"))
    whole = (F.col("judges") == judges) & (F.col("n") == judges)
    done = g.where(whole).select("key", (F.col("n_match") >= 2).alias("correct"), "n_match", "n_no_match", "n_no_answer", "unanimous")
    return done, g.where(~whole).select("key", "judges")


def panel_labels(panel_rows: DataFrame, covariates: DataFrame) -> DataFrame:
    """correct_count, no_answer_count and k per question beside its covariates; questions without any have nulls there."""
    q = F.split("key", ":")[0].cast("long")
    g = panel_rows.groupBy(q.alias("question_id")).agg(F.count_if("correct").alias("correct_count"), F.count_if(F.col("n_no_answer") > 0).alias("no_answer_count"), F.count(F.lit(1)).alias("k"))
    return g.join(covariates, "question_id", "left")


def completeness(labels: DataFrame, corpus: DataFrame, k: int | Column) -> DataFrame:
    """One row (questions, expected, wrong_k, complete) of panel labels against the convertible corpus."""
    have = labels.agg(F.count_distinct("question_id").alias("questions"), F.count_if(F.col("k") != k).alias("wrong_k"))
    want = corpus.where("convertible").agg(F.count_distinct("question_id").alias("expected"))
    return have.crossJoin(want).withColumn("complete", (F.col("questions") == F.col("expected")) & (F.col("wrong_k") == 0))  # one row each


def majority(vote: Column) -> Column:
    """J7, an aggregate: true or false with two such votes and more than half of all (two of three), else null; other and null votes are votes for neither."""
    votes = F.count(F.lit(1))

    def wins(v: str) -> Column:
        n = F.count_if(vote == v)
        return (n >= 2) & (2 * n > votes)

    return F.when(wins("yes"), True).when(wins("no"), False)


def consensus(votes: DataFrame, key: str = "key", verdict: str = "verdict") -> DataFrame:
    """Per item the binary majority of `match`, and the three-way verdict that at least two raters gave (null: split)."""
    n = votes.groupBy(key, verdict).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg((F.coalesce(F.sum(F.when(F.col(verdict) == "match", F.col("n"))), F.lit(0)) >= 2).alias("match"),
                              F.when(F.max("n") >= 2, F.max_by(verdict, "n")).alias("verdict"))


def prompt_ratings(ratings: DataFrame, key: str = "prompt", level: str = "rating_level", local_from: int = 3, levels: int = 6, raters: int | None = 3) -> DataFrame:
    """Of exactly `raters` ratings (None: however many) the lower median and the route of more than half; they agree by construction, `agrees` tells.

    Ratings without a level (0 to `levels` - 1) are left out. Levels are counted, so a prompt with most ratings needs no more memory than another.
    """
    at = [F.count_if(F.col(level) == i) for i in range(levels)]
    g = ratings.where(F.col(level).between(0, levels - 1)).groupBy(key).agg(F.array(*at).alias("_c"), F.count(F.lit(1)).alias("_k"), F.count_if(F.col(level) >= local_from).alias("_n"))
    if raters is not None:
        g = g.where(F.col("_k") == raters)
    below = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda i: F.aggregate(F.slice("_c", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    median = F.size(F.filter(below, lambda b: 2 * b < F.col("_k")))  # levels with less than half of the ratings up to them
    g = g.select(key, median.alias("median_level"), (2 * F.col("_n") > F.col("_k")).alias("local"))
    return g.withColumn("agrees", (F.col("median_level") >= local_from) == F.col("local"))


def cohorts(corpus: DataFrame, labels: DataFrame, split: DataFrame, study: DataFrame, part: str = "test") -> DataFrame:
    """Convertible items of one split with their labels, as cohort `study` (in `study`) or `remainder`."""
    base = corpus.where("convertible").select("question_id", "category").join(split.where(F.col("split") == part), "question_id", "left_semi").join(labels, "question_id")
    mark = study.select("question_id").distinct().withColumn("_in", F.lit(True))
    return base.join(mark, "question_id", "left").withColumn("cohort", F.when(F.col("_in"), "study").otherwise("remainder")).drop("_in")
