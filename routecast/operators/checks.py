"""Validation: every check returns its violations; `enforce` raises if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(names: list[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def duplicates(df: DataFrame, key: list[str] | str) -> DataFrame:
    """V1: key values that occur more than once, with `n`."""
    return df.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """V2: (rule, n) of rows that do not satisfy each rule; null counts as a violation. One pass over the rows."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(failed).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def key_difference(left: DataFrame, right: DataFrame, key: list[str] | str) -> DataFrame:
    """V3: keys that only one side has, with `side` (missing: only left, extra: only right)."""
    keys = _keys(key)
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, keys, "full_outer").where("_l is null or _r is null")
    return both.select(*keys, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("side"))


def outside(subset: DataFrame, whole: DataFrame, key: list[str] | str) -> DataFrame:
    """V4: keys of `subset` that `whole` lacks."""
    return subset.select(*_keys(key)).distinct().join(whole, _keys(key), "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: list[str] | str) -> DataFrame:
    """V4: keys that both have."""
    return a.select(*_keys(key)).distinct().join(b, _keys(key), "left_semi")


def disagreements(a: DataFrame, b: DataFrame, key: list[str] | str, fields: list[str]) -> DataFrame:
    """V5: (keys, field) where both sides have the key and the field differs, null being a value."""
    keys = _keys(key)
    r = b.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    differs = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return a.select(*keys, *fields).join(r, keys).select(*keys, F.explode(differs).alias("field"))


def _values(df: DataFrame, keys: list[str], fields: list[str], wildcard: tuple[str, ...] = ()) -> DataFrame:
    """(keys, field, n) for fields with more than one value in a group; null is a value but for `wildcard` fields.

    Each field is made distinct by itself: counted together, each row would be multiplied by the fields before it meets the first aggregate, all in the memory of one task.
    """
    def one(f: str) -> DataFrame:
        v = df.select(*keys, F.col(f).alias("_v")).distinct()
        return v.groupBy(*keys).agg(F.count("_v" if f in wildcard else F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit(f).alias("field"), "n")

    return reduce(DataFrame.union, [one(f) for f in fields])


def unstable(df: DataFrame, group: list[str] | str, fields: list[str]) -> DataFrame:
    """V6: (group, field, n) for fields with more than one value in a group; null counts as a value."""
    return _values(df, _keys(group), fields)


def answer_key_faults(key: DataFrame, labels: DataFrame) -> DataFrame:
    """V7: (question_id, fault): no_label, no_key, wrong_text (option at answer_index) or identity (question or category)."""
    l = labels.select("question_id", F.col("question").alias("_q"), F.col("category").alias("_c"), F.lit(True).alias("_has"))
    j = key.withColumn("_key", F.lit(True)).join(l, "question_id", "full_outer")
    right = F.get("options", F.col("answer_index")).eqNullSafe(F.col("answer_text"))
    same = F.col("question").eqNullSafe(F.col("_q")) & F.col("category").eqNullSafe(F.col("_c"))
    fault = F.when(F.col("_has").isNull(), "no_label").when(F.col("_key").isNull(), "no_key").when(~right, "wrong_text").when(~same, "identity")
    return j.select("question_id", fault.alias("fault")).where("fault is not null")


def identity_changes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """V8: keys whose identity fields are not equal in all repeats."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields])).alias("n")).where("n > 1")


def fingerprint(df: DataFrame, group: list[str], line: Column) -> DataFrame:
    """T4: order-free print of the lines of each group: count, sum of 60-bit hash slices and their xor."""
    h = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")
    d = df.select(*group, h.alias("_h"))
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("_h").alias("hash_xor"))


def equal_repeats(df: DataFrame, rep: str, key: str, response: str) -> DataFrame:
    """V9: pairs of repeats (rep_a < rep_b) with the same responses to all keys; joins one fingerprint per repeat."""
    line = F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(F.substring(F.sha2(F.col(response), 256), 1, 16), F.lit("-")))
    p = fingerprint(df, [rep], line)
    a, b = p.withColumnRenamed(rep, "rep_a"), p.withColumnRenamed(rep, "rep_b")
    return a.join(b, ["n", "hash_sum", "hash_xor"]).where("rep_a < rep_b").select("rep_a", "rep_b")


def spread(df: DataFrame, count: str = "correct_count", k: str = "k") -> DataFrame:
    """(share, n) histogram rows and whether any count is strictly between 0 and k."""
    varied = F.coalesce(F.bool_or((F.col(count) > 0) & (F.col(count) < F.col(k))), F.lit(False))
    return df.agg(varied.alias("varied"), F.count_if(F.col(count) == 0).alias("none"), F.count_if(F.col(count) == F.col(k)).alias("all"), F.count(F.lit(1)).alias("n"))


def instruments(df: DataFrame, group: list[str], fields: list[str], wildcard: tuple[str, ...] = ()) -> DataFrame:
    """(group, field, n) for instrument fields with several values in a group; null is no value for `wildcard` fields."""
    return _values(df, _keys(group), fields, wildcard)


def manifest_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, left, right) on which two (key, value) manifests differ or which one of them lacks."""
    l, r = a.select("key", F.col("value").alias("left")), b.select("key", F.col("value").alias("right"))
    return l.join(r, "key", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def design_faults(design: DataFrame, raters: int, per_category: int) -> DataFrame:
    """(rule, n) of a rater design (participant_id, prompt_id, category).

    Pairs of prompt and participant are dealt by prompt into as many parts as the session shuffles to: a number that is given is not merged again, so a task holds the pairs of a small part.
    """
    parts = int(design.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = design.select("participant_id", "prompt_id").repartition(parts, "prompt_id").groupBy("prompt_id", "participant_id").agg(F.count(F.lit(1)).alias("n"))
    prompts = pairs.groupBy("prompt_id").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count("participant_id").alias("n"))
    cells = design.groupBy("participant_id", "category").agg(F.count(F.lit(1)).alias("n"))
    found = prompts.agg(F.sum("repeated").alias("repeated_prompt"), F.count_if(F.col("n") != raters).alias("rater_count")).crossJoin(
        cells.agg(F.count_if(F.col("n") != per_category).alias("category_count")))  # one row each
    return found.unpivot([], ["repeated_prompt", "category_count", "rater_count"], "rule", "n").where("n > 0")


def pair_overlap(design: DataFrame, participant: str = "participant_id", prompt: str = "prompt_id", most: int = 256) -> DataFrame:
    """(a, b, shared) prompts shared by each rater pair; repeated rows count once.

    The result is the pairs themselves. Raters of a prompt are dealt into blocks of about `most`, and pairs are made by block against block, so a
    prompt with few raters is one key, and one with most of the rows spreads over many tasks.
    """
    d = design.select(F.col(participant).alias("a"), F.col(prompt).alias("p")).where("a is not null and p is not null").distinct()
    size = d.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    d = d.join(size, "p").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    left = d.select("p", F.col("a").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = d.select("p", F.col("a").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    met = left.join(right, ["p", "i", "j"]).where("i < j or x < y")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def stage_coverage(first: DataFrame, second: DataFrame, rewrites: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, fault): rejected items need a second decision, survivors a rewrite, and neither stage has others.

    `first` and `second` have the key and `convertible`; `rewrites` the key and `error` (null: done).
    """
    rejected = first.where("not convertible").select(key)
    survivors = first.where("convertible").select(key).union(second.where("convertible").select(key)).distinct()
    say = lambda df, fault: df.select(key, F.lit(fault).alias("fault"))
    return say(rejected.join(second, key, "left_anti"), "no_second").union(say(second.join(rejected, key, "left_anti"), "surplus_second")).union(
        say(survivors.join(rewrites, key, "left_anti"), "no_rewrite")).union(say(rewrites.join(survivors, key, "left_anti"), "surplus_rewrite")).union(
        say(rewrites.where("error is not null"), "failed"))


def reconciliation(stored: DataFrame, computed: DataFrame, key: list[str] | str, value: str, rel: float = 0.0, absolute: float = 1e-8) -> DataFrame:
    """Keys whose stored value is not within max(absolute, rel * larger magnitude) of the recomputed one, or that one side lacks."""
    keys = _keys(key)
    j = stored.select(*keys, F.col(value).alias("stored")).join(computed.select(*keys, F.col(value).alias("computed")), keys, "full_outer")
    close = F.abs(F.col("stored") - F.col("computed")) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs("stored"), F.abs("computed")))
    both_null = F.col("stored").isNull() & F.col("computed").isNull()
    return j.where(~F.coalesce(close, both_null))


def replay(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-5) -> DataFrame:
    """One row (n, max_error, agrees) over equal keys."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    worst = F.max(F.abs(F.col("_a") - F.col("_b")))
    return j.agg(F.count(F.lit(1)).alias("n"), worst.alias("max_error"), F.coalesce(worst <= tolerance, F.lit(False)).alias("agrees"))


def allocation_audit(drawn: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, target, realised and state (equal, above, below) against `plan` (keys, target)."""
    have = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("realised"))
    j = plan.select(*keys, "target").join(have, keys, "full_outer").na.fill(0, ["target", "realised"])
    state = F.when(F.col("realised") == F.col("target"), "equal").when(F.col("realised") > F.col("target"), "above").otherwise("below")
    return j.select(*keys, "target", "realised", state.alias("state"))


def stimulus_faults(items: DataFrame) -> DataFrame:
    """(rule, n) for calibration items (key, question_id, rep, response, chars)."""
    bad = violations(items, {"key": F.col("key") == F.concat_ws(":", "question_id", "rep"), "text": F.trim("response") != "", "chars": F.col("chars") == F.length("response")})
    more = duplicates(items, "key").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("unique").alias("rule"), "n")
    return bad.union(more)


def key_corpus_faults(key: DataFrame, corpus: DataFrame) -> DataFrame:
    """(blind_id, fault) of blind keys (blind_id, question_id, stratum, convertible) against the corpus' stratum and decision."""
    c = corpus.select("question_id", F.col("stratum").alias("_s"), F.col("convertible").alias("_v"))
    j = key.join(c, "question_id", "left")
    fault = F.when(F.col("_s").isNull(), "unknown").when(F.col("stratum") != F.col("_s"), "stratum").when(F.col("convertible") != F.col("_v"), "decision")
    again = duplicates(key, "question_id").select("question_id").join(key, "question_id").select("blind_id", F.lit("repeated").alias("fault"))
    return j.select("blind_id", fault.alias("fault")).where("fault is not null").union(again)


def blind_design(order: DataFrame, verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """(rule, n): repeated blind or real ids, verdicts not covering the order, runs (run, id) not covering it.

    What the runs lack is counted, all ids less a run's own known ones; no run meets ids that it has no row for.
    """
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(rule).alias("rule"), "n")
    ids = order.select("id").distinct()
    seen = runs.select("run", "id").distinct().join(ids.withColumn("known", F.lit(True)), "id", "left")
    per = seen.groupBy("run").agg(F.count("known").alias("have"), F.count_if(F.col("known").isNull()).alias("more"))
    total = ids.agg(F.count(F.lit(1)).alias("all"))
    off = per.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("all") - F.col("have") + F.col("more")), F.lit(0)).cast("long").alias("n"))  # one row
    return count(duplicates(order, "blind_id"), "blind_id").union(count(duplicates(order, "id"), "id")).union(
        count(key_difference(order, verdicts, "blind_id"), "verdicts")).union(off.where("n > 0").select(F.lit("runs").alias("rule"), "n"))


def matrix_faults(ratings: DataFrame, per_prompt: int = 3, raters: int | None = None) -> DataFrame:
    """(prompt, fault) for prompts without `per_prompt` distinct raters, or with repeated ones; null prompt: wrong number of raters."""
    g = ratings.groupBy("prompt").agg(F.count_distinct("rater").alias("d"), F.count(F.lit(1)).alias("n"))
    bad = g.select("prompt", F.when(F.col("d") != F.col("n"), "repeated").when(F.col("d") != per_prompt, "raters").alias("fault")).where("fault is not null")
    if raters is None:
        return bad
    whole = ratings.agg(F.count_distinct("rater").alias("d")).where(F.col("d") != raters)
    return bad.union(whole.select(F.lit(None).cast(ratings.schema["prompt"].dataType).alias("prompt"), F.lit("plan").alias("fault")))


def vote_faults(votes: DataFrame, expected: DataFrame, allowed: tuple[str, ...] = ("yes", "no", "borderline")) -> DataFrame:
    """(rater, fault, n) for votes (rater, key, id, vote): repeated, missing, unknown items and votes outside the set.

    What a rater lacks is counted: all expected items less those known among the rater's own. No rater meets items without a vote.
    """
    v = votes.select("rater", F.coalesce("key", "id").alias("item"), "vote")
    wanted = expected.select(F.col("id").alias("item")).distinct()
    per = v.groupBy("rater", "item").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("vote").isin(*allowed), F.lit(False))).alias("bad"))
    seen = per.join(wanted.select("item", F.lit(True).alias("known")), "item", "left")
    g = seen.groupBy("rater").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown"), F.sum("bad").alias("vote"), F.count("known").alias("have"))
    total = wanted.agg(F.count(F.lit(1)).alias("all"))
    g = g.crossJoin(F.broadcast(total)).withColumn("missing", F.col("all") - F.col("have"))  # one row
    return g.unpivot(["rater"], ["repeated", "missing", "unknown", "vote"], "fault", "n").where("n > 0")


def enforce(found: DataFrame, what: str = "check") -> None:
    """Raises with the first few violations if there are any."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
