"""Stratified draws, quotas and rater assignment.

Random order is the order of md5(seed:stratum:key), so a draw does not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routecast.operators.prefix import running

LEVELS = 6
SURPLUS = (2, 3, 1, 4, 0, 5)  # bands that get a surplus first


def draw_order(seed: int, *parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def restricted(df: DataFrame, assignment: DataFrame, part: str, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(rows assigned to `part`, rows without assignment)."""
    return df.join(assignment.where(F.col("split") == part), key, "left_semi"), df.join(assignment, key, "left_anti")


def band_targets(n: int, levels: int = LEVELS) -> list[int]:
    """An even split of n over the bands."""
    return [n // levels + (SURPLUS.index(b) < n % levels) for b in range(levels)]


def donor_ranks(levels: int = LEVELS) -> list[list[int]]:
    """For each band, the rank of every other band as a donor: nearest first, then the one nearer the middle, then the lower; a band is no donor of its own."""
    return [[sorted(range(levels), key=lambda d: (d == b, abs(d - b), abs(2 * d - levels + 1), d)).index(d) for d in range(levels)] for b in range(levels)]


def allocation(pools: DataFrame, per_category: int, category: str = "category", level: str = "level") -> DataFrame:
    """D3: (category, level, target, take, pool); what a band lacks comes from its donors by rank, as far as they have room.

    A donor gives what is left of the lack after the rooms of all better donors, held between 0 and its own room, so a band is settled for
    all donors at once; the bands are a fold. A category whose takes do not add up gets null takes.
    """
    wide = pools.groupBy(category).agg(*[F.coalesce(F.sum(F.when(F.col(level) == b, F.col("pool"))), F.lit(0)).cast("long").alias(f"_p{b}") for b in range(LEVELS)])
    wide = wide.withColumn("_pool", F.array(*[F.col(f"_p{b}") for b in range(LEVELS)])).drop(*[f"_p{b}" for b in range(LEVELS)])
    targets, pool = F.array(*[F.lit(t).cast("long") for t in band_targets(per_category)]), F.col("_pool")
    at = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    ranks = F.array(*[F.array(*[F.lit(r) for r in row]) for row in donor_ranks()])

    def settled(take: Column, band: Column) -> Column:
        lack, rank = F.greatest(F.lit(0).cast("long"), F.get(take, band) - F.get(pool, band)), F.get(ranks, band)
        room = F.transform(at, lambda d: F.when(d == band, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.get(pool, d) - F.get(take, d))))
        before = lambda d: F.aggregate(F.filter(at, lambda o: F.get(rank, o) < F.get(rank, d)), F.lit(0).cast("long"), lambda s, o: s + F.get(room, o))
        return F.transform(at, lambda d: F.when(d == band, F.get(take, d) - lack).otherwise(F.get(take, d) + F.greatest(F.lit(0).cast("long"), F.least(F.get(room, d), lack - before(d)))))

    take = F.aggregate(at, targets, settled)
    whole = F.aggregate("_take", F.lit(0).cast("long"), lambda s, t: s + t) == per_category
    done = wide.withColumn("_take", take).withColumn("_take", F.when(whole, F.col("_take")))
    return done.select(category, F.posexplode("_pool").alias(level, "_n"), targets.alias("_t"), "_take").select(
        category, level, F.get("_t", F.col(level)).cast("int").alias("target"), F.get("_take", F.col(level)).cast("int").alias("take"), F.col("_n").cast("int").alias("pool"))


def stratified_draw(df: DataFrame, per_category: int, seed: int, key: str = "question_id", category: str = "category", level: str = "level") -> DataFrame:
    """The rows drawn per (category, level) in seeded order.

    No band takes more than `per_category` rows, so each task keeps that many of a band before anything is shuffled.
    """
    pools = df.groupBy(category, level).agg(F.count(F.lit(1)).alias("pool"))
    take = allocation(pools, per_category, category, level).where("take > 0").select(category, level, "take")
    w = Window.partitionBy(category, level).orderBy(draw_order(seed, category, key), key)
    first = df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= per_category)
    return first.join(take, [category, level]).where("_place <= take").drop("_place", "take")


def sqrt_allocation(populations: DataFrame, total: int, fixed: str = "borderline", quota: int = 50, least: int = 12) -> DataFrame:
    """(stratum, population, draw): min(quota, population) for `fixed`, max(least, round(sqrt(population) * scale)) for the others, at most the population."""
    is_fixed = F.col("stratum") == fixed
    one = Window.partitionBy(F.lit(1))  # a row per stratum
    spent = F.coalesce(F.sum(F.when(is_fixed, F.least(F.lit(quota), F.col("population")))).over(one), F.lit(0))
    roots = F.sum(F.when(~is_fixed, F.sqrt("population"))).over(one)
    scale = F.greatest(F.lit(0), F.lit(total) - spent) / roots
    share = F.when(is_fixed, F.lit(quota)).otherwise(F.greatest(F.lit(least), F.bround(F.sqrt("population") * scale, 0)))
    return populations.select("stratum", "population", F.least(share, F.col("population")).cast("long").alias("draw"))


def stratified_sample(df: DataFrame, draws: DataFrame, seed: int, key: str) -> DataFrame:
    """`draw` rows per stratum in seeded order, in a seeded blind order with `place` and `blind_id`."""
    from routecast.functions.expr import blind_id

    w = Window.partitionBy("stratum").orderBy(draw_order(seed, "stratum", key), key)
    s = df.withColumn("_p", F.row_number().over(w)).join(F.broadcast(draws.select("stratum", "draw")), "stratum").where("_p <= draw").drop("_p", "draw")
    place = F.row_number().over(Window.orderBy(draw_order(seed, F.lit("blind"), key), key))  # the sample is small by its quotas
    return s.withColumn("place", place).withColumn("blind_id", blind_id(F.col("place")))


def priority_sample(df: DataFrame, seed: int, key: str = "key", length: str = "length", category: str = "category", flag: str = "list_style",
                    shortest: int = 15, longest: int = 10, flagged: int = 5, per_category: int = 5, total: int = 100) -> DataFrame:
    """Quotas in turn - shortest, longest, flagged, some per category, then a fill to `total`; each skips what is chosen. Adds `quota`.

    Each step is a top-k (its feature); only chosen keys are carried on.
    """
    d = df.select(key, length, category, flag)
    chosen: DataFrame | None = None

    def take(name: str, pool: DataFrame, n: int, *order: Column) -> None:
        nonlocal chosen
        rest = pool if chosen is None else pool.join(F.broadcast(chosen.select(key)), key, "left_anti")
        new = rest.orderBy(*order, F.col(key)).limit(n).select(key, F.lit(name).alias("quota"))
        chosen = new if chosen is None else chosen.unionByName(new)

    random = draw_order(seed, key)
    take("shortest", d, shortest, F.col(length))
    take("longest", d, longest, F.col(length).desc())
    take("flagged", d.where(flag), flagged, random)
    rest = d.join(F.broadcast(chosen.select(key)), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(category).orderBy(random, key))
    chosen = chosen.unionByName(rest.withColumn("_p", place).where(F.col("_p") <= per_category).select(key, F.lit("category").alias("quota")))
    have = chosen.count()
    if have < total:
        take("fill", d, total - have, random)
    return chosen


def assignment(prompts: DataFrame, seed: int, participants: int, raters: int, per_participant: int) -> tuple[DataFrame, DataFrame]:
    """(participant, prompt_id, category) and the categories whose numbers do not divide.

    Slot s of a category goes to the rater at s div per_participant and the prompt at s mod n of two seeded orders.
    """
    n = prompts.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    fits = (F.col("n") * raters == participants * per_participant) & (per_participant <= F.col("n")) & (F.col("n") % per_participant == 0)
    good, bad = n.where(fits), n.where(~fits)
    item = prompts.join(good, "category").select("category", "prompt_id", "n", (F.row_number().over(Window.partitionBy("category").orderBy(draw_order(seed, F.lit("item"), "category", "prompt_id"), "prompt_id")) - 1).alias("item"))
    people = good.select("category", F.explode(F.sequence(F.lit(0), F.lit(participants - 1))).alias("participant"))
    people = people.select("category", "participant", (F.row_number().over(Window.partitionBy("category").orderBy(draw_order(seed, F.lit("rater"), "category", "participant"), "participant")) - 1).alias("place"))
    slots = item.select("category", "prompt_id", F.explode(F.sequence(F.lit(0), F.lit(raters - 1))).alias("r"), (F.col("item") + F.col("r") * F.col("n")).alias("slot"))
    slots = slots.withColumn("place", F.floor(F.col("slot") / per_participant).cast("int"))
    return slots.join(people, ["category", "place"]).select("participant", "prompt_id", "category"), bad


def participant_order(plan: DataFrame, seed: int, attention: bool = True) -> DataFrame:
    """(participant, position, prompt_id, category) in seeded order, with one attention row after the first."""
    w = Window.partitionBy("participant").orderBy(draw_order(seed, "participant", "prompt_id"), "prompt_id")
    p = plan.select("participant", "prompt_id", "category", F.row_number().over(w).cast("double").alias("at"))
    if attention:
        n = p.groupBy("participant").agg(F.count(F.lit(1)).alias("n"))
        where = F.conv(F.substring(draw_order(seed, F.lit("attention"), "participant"), 1, 8), 16, 10).cast("long") % F.col("n")
        p = p.unionByName(n.select("participant", F.concat(F.lit("ATT-"), F.col("participant").cast("string")).alias("prompt_id"), F.lit("attention").alias("category"), (where + 1.5).alias("at")))
    return p.select("participant", (F.row_number().over(Window.partitionBy("participant").orderBy("at"))).alias("position"), "prompt_id", "category")


def with_texts(drawn: DataFrame, texts: DataFrame, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(rows with normalised prompt text and whether it changed, keys with an empty or missing text)."""
    from routecast.functions.expr import math_delimiters

    j = drawn.join(texts.select(key, "text"), key, "left")
    ok = F.trim(F.coalesce("text", F.lit(""))) != ""
    new = math_delimiters(F.col("text"))
    return j.where(ok).select(*drawn.columns, new.alias("prompt_text"), (new != F.col("text")).alias("changed")), j.where(~ok).select(key)


def packages(items: DataFrame, annotators: list[str], seed: int, key: str) -> DataFrame:
    """Every item once per annotator, `place` in an order of the annotator's own. Keys are unique.

    Places are running counts over ranges of the order, so an annotator's rows spread over tasks.
    """
    names = items.sparkSession.createDataFrame([(a,) for a in annotators], "annotator string")
    order = F.concat_ws(":", draw_order(seed, "annotator", key), F.col(key).cast("string"))
    rows = items.crossJoin(F.broadcast(names)).withColumns({"_o": order, "_one": F.lit(1).cast("long")})  # a fixed list of annotators
    return running(rows, "_o", ["_one"], ["annotator"]).withColumnRenamed("_one_upto", "place").drop("_o", "_one", "_one_all")


def design_faults(plan: DataFrame, prompts: int, categories: int, participants: int, per_participant: int) -> DataFrame:
    """(rule, found, wanted) where the design differs from the wanted one."""
    g = plan.agg(F.count_distinct("prompt_id").alias("prompts"), F.count_distinct("category").alias("categories"), F.count_distinct("participant").alias("participants"))
    load = plan.groupBy("participant").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") != per_participant).alias("uneven"))
    wanted = {"prompts": prompts, "categories": categories, "participants": participants, "uneven": 0}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("found"), F.lit(v).cast("long").alias("wanted")) for k, v in wanted.items()])).alias("x")
    return g.crossJoin(load).select(rows).select("x.*").where("found <> wanted")  # one row each


def seeded_limit(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """A reproducible sample of n rows."""
    return df.orderBy(draw_order(seed, key), key).limit(n)
