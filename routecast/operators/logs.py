"""Append-only logs: reduction, resuming and merging of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecast.operators import checks
from routecast.operators.prefix import running


def latest(df: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """L1: the last row of each key by `seq`; a partial aggregate, so a key with many rows does not meet in one task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_r")).select(key, "_r.*").select(*df.columns)


def pending(items: DataFrame, done: DataFrame, key: str, retry_errors: bool = False) -> DataFrame:
    """L2: items without a completed record; failed ones again if `retry_errors` (`done` has a boolean `error`)."""
    return items.join(done.where("not error") if retry_errors else done, key, "left_anti")


def failed(df: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """L3: keys whose latest record is an error."""
    return latest(df, key, seq).where("error").select(key)


def error_runs(df: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """L4: (key, longest, total) of consecutive errors per source. Errors of one run share the running count of other rows before them, so no source needs one task."""
    ok = F.when(F.col("error"), 0).otherwise(1).cast("long")
    r = running(df.select(key, F.struct(*seq).alias("_s"), "error", ok.alias("_ok")), "_s", ["_ok"], [key])
    runs = r.where("error").groupBy(key, "_ok_upto").agg(F.count(F.lit(1)).alias("n"))
    found = runs.groupBy(key).agg(F.max("n").alias("longest"), F.sum("n").alias("total"))
    return df.select(key).distinct().join(found, key, "left").na.fill(0, ["longest", "total"])


def stage_records(df: DataFrame, key: str, seq: list[str]) -> tuple[DataFrame, DataFrame]:
    """(latest completed record per key, keys completed more than once)."""
    done = df.where("not error")
    return latest(done, key, seq), checks.duplicates(done, key)


def merged(first: DataFrame, second: DataFrame, key: str = "question_id") -> DataFrame:
    """The first decision unless it rejected and there is a second one. Both have the key, convertible, stage, reason."""
    fields = ["convertible", "stage", "reason"]
    s = second.select(key, F.struct(*fields).alias("_s"))
    own = F.struct(*fields)
    j = first.join(s, key, "left").withColumn("_d", F.when(~F.col("convertible"), F.coalesce("_s", own)).otherwise(own))
    return j.select(*[c for c in first.columns if c not in fields], "_d.*")


def attached(decisions: DataFrame, rewrites: DataFrame, key: str = "question_id") -> DataFrame:
    """Survivors with a rewrite keep it; an empty one drops them at stage rewrite, a failed one at rewrite_error."""
    r = rewrites.select(key, F.col("text").alias("_t"), F.col("error").alias("_e"), F.lit(True).alias("_has"))
    j = decisions.join(r, key, "left")
    survives, broken = F.col("convertible"), F.coalesce("_e", F.lit(False)) | F.col("_has").isNull()
    empty = F.trim(F.coalesce("_t", F.lit(""))) == ""
    stage = F.when(survives & broken, "rewrite_error").when(survives & empty, "rewrite").otherwise(F.col("stage"))
    kept = survives & ~broken & ~empty
    return j.select(*[c for c in decisions.columns if c not in ("convertible", "stage")], kept.alias("convertible"), stage.alias("stage"), F.when(kept, F.trim("_t")).alias("open_question"))


def replayed(judged: DataFrame, rescored: DataFrame, rewrites: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The three logs reduced, merged and attached; failed rewrites removed."""
    first, second, text = (stage_records(x, key, seq)[0] for x in (judged, rescored, rewrites))
    return attached(merged(first, second, key), text, key).where("stage <> 'rewrite_error'")


def conversion_summary(df: DataFrame) -> DataFrame:
    """Decided, kept and share per list style and in all (`list_style` null), with stage counts."""
    g = df.rollup("list_style").agg(F.count(F.lit(1)).alias("decided"), F.count_if("convertible").alias("kept"), *[
        F.count_if(~F.col("convertible") & (F.col("stage") == s)).alias(f"dropped_{s}") for s in ("judge", "rescore", "rewrite")], F.grouping("list_style").alias("whole"))
    return g.withColumn("rate", F.try_divide("kept", "decided"))


def open_corpus(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Convertible rows with defaults and trimmed text; the first `limit` by id (a top-k, where that is asked for)."""
    out = df.where("convertible").select("question_id", F.trim("question").alias("question"), F.coalesce("category", F.lit("unknown")).alias("category"),
                                         F.coalesce("list_style", F.lit(False)).alias("list_style"))
    return out.orderBy("question_id").limit(limit) if limit is not None else out


def decision_records(items: DataFrame, verdicts: DataFrame, instrument: str, admit: int = 5) -> DataFrame:
    """One row per item with its decision: the verdict's own, or admitted by a score of at least `admit`."""
    v = verdicts.select("question_id", "score", F.col("convertible").alias("_own"), "reason")
    decision = F.coalesce(F.col("score") >= admit, F.col("_own"), F.lit(False))
    return items.join(v, "question_id").select(*items.columns, decision.alias("convertible"), "score", "reason", F.lit(instrument).alias("instrument"))
