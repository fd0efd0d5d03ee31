"""Agreement statistics from contingency cells.

A pair table is reduced once to cells (group, a, b, n); every statistic is arithmetic on the at most 36 cells
of a group, so nothing here depends on the number of rows behind them. Whole-number sums are decimal(38,0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routecast.operators.joins import salted_join
from routecast.operators.panel import majority
from routecast.operators.prefix import with_quantiles

DEC = "decimal(38,0)"


def cells(df: DataFrame, a: str, b: str, group: list[str] = ()) -> DataFrame:
    """(group, a, b, n)."""
    return df.groupBy(*group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _dec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(DEC)


def _pairs(c: DataFrame, group: list[str]) -> DataFrame:
    """Cells against cells of the same group (at most 36 x 36 rows a group)."""
    right = c.select(*group, F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    return c.join(right, list(group)) if group else c.crossJoin(right)


def weighted_kappa(c: DataFrame, group: list[str] = (), zero: str = "null") -> DataFrame:
    """A1, A2, A3: linear weighted kappa (E - n O) / E as exact numerator and denominator and as double.

    O is the sum of |a - b| over pairs, E that of |a - b| over the products of the marginals. If E is 0 the value is null
    (`zero="null"`) or 1 (`zero="one"`, where both raters used one equal level).
    """
    group = list(group)
    own = c.groupBy(*group).agg(F.sum(_dec("n")).alias("n"), F.sum(_dec(F.abs(F.col("a") - F.col("b"))) * F.col("n")).cast(DEC).alias("o")) if group else c.agg(
        F.sum(_dec("n")).alias("n"), F.sum(_dec(F.abs(F.col("a") - F.col("b"))) * F.col("n")).cast(DEC).alias("o"))
    ra = c.groupBy(*group, "a").agg(F.sum("n").alias("na"))
    rb = c.groupBy(*group, "b").agg(F.sum("n").alias("nb"))
    both = ra.join(rb, group) if group else ra.crossJoin(rb)  # at most 6 x 6 a group
    e = F.sum((_dec(F.abs(F.col("a") - F.col("b"))) * _dec(F.col("na"))).cast(DEC) * _dec(F.col("nb"))).cast(DEC).alias("e")
    e = both.groupBy(*group).agg(e) if group else both.agg(e)
    j = own.join(e, group) if group else own.crossJoin(e)
    numerator = (F.col("e") - (F.col("n") * F.col("o")).cast(DEC)).cast(DEC)
    value = F.try_divide(numerator.cast("double"), F.col("e").cast("double"))
    if zero == "one":
        value = F.when(F.col("e") == 0, F.lit(1.0)).otherwise(value)
    return j.select(*group, F.col("n").cast("long").alias("n"), numerator.alias("numerator"), F.col("e").alias("denominator"), value.alias("kappa"))


def fleiss(ratings: DataFrame, item: str, category: str, group: list[str] = (), uneven: bool = False) -> DataFrame:
    """A4: Fleiss' kappa; null with fewer than two raters or unequal rater numbers (`even` false); 1 if chance agreement is 1.

    With `uneven`, rater numbers may differ: agreement is the mean over items of two or more, chance that of all ratings (the same where they are equal).
    """
    group = list(group)
    n = ratings.groupBy(*group, item, category).agg(F.count(F.lit(1)).alias("_n"))
    per = n.groupBy(*group, item).agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.col("_n")).alias("_sq"))
    agree = per.groupBy(*group).agg(F.count(F.lit(1)).alias("items"), F.min("_m").alias("_lo"), F.max("_m").alias("_hi"), F.sum("_m").alias("_total"),
                                    F.avg(F.try_divide(F.col("_sq") - F.col("_m"), F.col("_m") * (F.col("_m") - 1))).alias("_observed"))
    by = n.groupBy(*group, category).agg(F.sum("_n").alias("_c"))
    chance = by.groupBy(*group).agg(F.sum(_dec(F.col("_c") * F.col("_c"))).cast("double").alias("_chance"))
    j = agree.join(chance, group) if group else agree.crossJoin(chance)
    p = F.try_divide(F.col("_chance"), F.col("_total").cast("double") * F.col("_total").cast("double"))
    even = (F.col("_lo") == F.col("_hi")) & (F.col("_lo") >= 2)
    kappa = F.when(F.col("_observed").isNull() if uneven else ~even, None).when(p == 1, F.lit(1.0)).otherwise(F.try_divide(F.col("_observed") - p, 1 - p))
    return j.select(*group, "items", F.coalesce(even, F.lit(False)).alias("even"), kappa.alias("kappa"))


def scotts_pi(df: DataFrame, left: Column, right: Column, group: list[str] = ()) -> DataFrame:
    """A5: Scott's pi of two boolean raters; with chance agreement 1 it is 1 if they always agree, else 0."""
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(left == right).alias("same"), (F.count_if(left) + F.count_if(right)).alias("yes"))
    p = F.col("yes") / (2 * F.col("n"))
    chance, seen = p * p + (1 - p) * (1 - p), F.col("same") / F.col("n")
    pi = F.when(F.col("n") == 0, None).when(chance == 1, F.when(seen == 1, 1.0).otherwise(0.0)).otherwise((seen - chance) / (1 - chance))
    return g.select(*group, "n", "same", pi.alias("pi"))


def ordinal_alpha(ratings: DataFrame, unit: str, level: str, group: list[str] = (), levels: int = 6) -> DataFrame:
    """Ordinal Krippendorff alpha; null with one value or no expected disagreement.

    Levels of a unit are counted, counts are crossed within the unit (at most `levels` squared) and summed over units by number of ratings m
    before the division by m - 1, so that sums stay whole.
    """
    group = list(group)
    n = ratings.groupBy(*group, unit, F.col(level).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    m = ratings.groupBy(*group, unit).agg(F.count(F.lit(1)).alias("m"))
    n = n.join(m, [*group, unit]).where("m >= 2")
    right = n.select(*group, unit, F.col("a").alias("b"), F.col("n").alias("n2"))
    o = n.join(right, [*group, unit]).groupBy(*group, "m", "a", "b").agg(F.sum(_dec(F.col("n") * F.col("n2") - F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))).alias("o"))
    o = o.groupBy(*group, "a", "b").agg(F.sum(F.col("o").cast("double") / (F.col("m") - 1)).alias("o"))
    margin = o.groupBy(*group, "a").agg(F.sum("o").alias("c"))
    spark = ratings.sparkSession
    grid = spark.range(levels).select(F.col("id").cast("int").alias("a"))
    groups = margin.select(*group).distinct() if group else None
    full = (groups.crossJoin(F.broadcast(grid)) if group else grid).join(margin, [*group, "a"], "left").na.fill(0.0, ["c"])
    # at most `levels` rows a group
    run = full.withColumn("upto", F.sum("c").over(Window.partitionBy(*(group or [F.lit(1)])).orderBy("a")))
    rb = run.select(*group, F.col("a").alias("b"), F.col("c").alias("cb"), F.col("upto").alias("uptob"))
    both = run.join(rb, group) if group else run.crossJoin(rb)
    low, high = F.least("upto", "uptob"), F.greatest("upto", "uptob")
    first = F.when(F.col("a") <= F.col("b"), F.col("c")).otherwise(F.col("cb"))
    mid = high - low + first - (F.col("c") + F.col("cb")) / 2
    both = both.withColumn("d", mid * mid).join(o, [*group, "a", "b"], "left").na.fill(0.0, ["o"])
    total = margin.groupBy(*group).agg(F.sum("c").alias("total"))
    both = both.join(total, group) if group else both.crossJoin(total)
    e = (F.col("c") * F.col("cb") - F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0.0)) / (F.col("total") - 1) * F.col("d")
    s = both.groupBy(*group).agg(F.max("total").alias("total"), F.sum(F.col("o") * F.col("d")).alias("observed"), F.sum(F.when(F.col("total") > 1, e)).alias("expected"))
    alpha = F.when((F.col("total") > 1) & (F.col("expected") != 0), 1 - F.col("observed") / F.col("expected"))
    return s.select(*group, F.round("total").cast("long").alias("values"), alpha.alias("alpha"))


def confusion(df: DataFrame, truth: Column, said: Column, group: list[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp and the rates; a zero denominator gives null."""
    g = df.groupBy(*group).agg(F.count_if(~truth & ~said).alias("tn"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(truth & said).alias("tp"))
    return with_rates(g)


def with_rates(g: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return g.withColumns({"fpr": F.try_divide(fp, fp + tn), "fnr": F.try_divide(fn, fn + tp), "coverage": F.try_divide(tp + fp, n), "precision": F.try_divide(tp, tp + fp), "accuracy": F.try_divide(tp + tn, n)})


def tau_b(c: DataFrame, group: list[str] = ()) -> DataFrame:
    """Kendall's tau-b from pairs of cells; null if either side is constant."""
    group = list(group)
    p = _pairs(c, group)
    da, db = F.signum((F.col("a") - F.col("a2")).cast("double")), F.signum((F.col("b") - F.col("b2")).cast("double"))
    w = _dec(F.col("n")) * _dec(F.col("n2"))
    both = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast(DEC)
    g = p.groupBy(*group).agg(both(da * db > 0).alias("con"), both(da * db < 0).alias("dis"), both((da == 0) & (db != 0)).alias("ta"), both((da != 0) & (db == 0)).alias("tb"))
    con, dis, ta, tb = (F.col(x).cast("double") / 2 for x in ("con", "dis", "ta", "tb"))  # every pair was met twice
    return g.select(*group, con.cast("long").alias("concordant"), dis.cast("long").alias("discordant"), F.try_divide(con - dis, F.sqrt((con + dis + ta) * (con + dis + tb))).alias("tau_b"))


def _log_stirling_rest(x: Column) -> Column:
    """log(x!) less Stirling's (x + 1/2) log x - x + log(2 pi) / 2, for whole x of 1 or more: a series from 16 on, steps down to smaller x."""
    high = F.greatest(x, F.lit(16.0))
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (high * high)) / (high * high)) / (high * high)) / high
    steps = F.aggregate(F.when(x < 16, F.sequence(x.cast("int"), F.lit(15))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + (j + 0.5) * F.log1p(1 / j) - 1)
    return series + steps


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) - x + mean."""
    share = (x - mean) / mean
    return mean * ((1 + share) * F.log1p(share) - share)


def upper_tail(k: Column, n: Column) -> Column:
    """The share of fair coin series of length n with k heads or more: the regularised incomplete beta function I(1/2; k, n - k + 1).

    Its series is a fold: the probability of k heads (by deviances, so that no large logarithms cancel) times the sum of the products of
    (n - k - j) / (k + j + 1), which fall below the last digit after some ten roots of n; below the middle, one less the other tail.
    """
    n, k = n.cast("double"), k.cast("double")
    far = F.when(2 * k > n, k).otherwise(n - k + 1)  # above the middle
    some, rest = F.greatest(F.least(far, n), F.lit(1.0)), n - far
    at = F.greatest(rest, F.lit(1.0))
    log_one = _log_stirling_rest(F.greatest(n, F.lit(1.0))) - _log_stirling_rest(some) - _log_stirling_rest(at) - _deviance(some, n / 2) - _deviance(at, n / 2) + 0.5 * F.log(n / (2 * F.pi() * some * at))
    one = F.when(rest < 0, F.lit(0.0)).when(rest == 0, F.pow(F.lit(0.5), n)).otherwise(F.exp(log_one))
    steps = F.when(rest >= 1, F.sequence(F.lit(0), F.least(rest - 1, 10 * F.sqrt(n) + 60).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, j: Column) -> Column:
        term = s.term * (rest - j) / (far + j + 1)
        return F.struct(term.alias("term"), (s.total + term).alias("total"))

    tail = F.least(F.lit(1.0), one * F.aggregate(steps, start, add, lambda s: s.total))
    return F.when(2 * k > n, tail).otherwise(1 - tail)


def mcnemar(g: DataFrame, fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Exact upper tails of the discordant counts in both directions, in column expressions."""
    n = F.col(fp) + F.col(fn)
    return g.withColumns({"p_false_local": upper_tail(F.col(fp), n), "p_false_cloud": upper_tail(F.col(fn), n)})


def pair_descriptors(df: DataFrame, truth: str, said: str, group: list[str] = (), local_from: int = 3) -> DataFrame:
    """A10: n, kappa, bias, absolute error and the 2x2 table of level pairs; the net is false cloud minus false local."""
    c = cells(df, truth, said, list(group))
    diff = F.col("b") - F.col("a")
    t, s = F.col("a") >= local_from, F.col("b") >= local_from
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    g = c.groupBy(*group).agg(F.try_divide(F.sum(diff * F.col("n")), F.sum("n")).alias("bias"), F.try_divide(F.sum(F.abs(diff) * F.col("n")), F.sum("n")).alias("mae"),
                              count(~t & ~s).alias("tn"), count(~t & s).alias("fp"), count(t & ~s).alias("fn"), count(t & s).alias("tp"))
    k = weighted_kappa(c, group)
    j = k.join(g, list(group)) if group else k.crossJoin(g)
    return j.withColumn("net_local", F.col("fp") - F.col("fn"))


def level_matrix(df: DataFrame, truth: str, said: str, levels: int = 6) -> DataFrame:
    """Counts of truth levels against said levels, all `levels` columns and rows."""
    grid = df.sparkSession.range(levels).select(F.col("id").cast("int").alias("truth"))
    p = df.groupBy(F.col(truth).cast("int").alias("truth")).pivot(said, list(range(levels))).agg(F.count(F.lit(1)))
    return grid.join(p, "truth", "left").na.fill(0).select("truth", *[F.col(str(i)).alias(f"said_{i}") for i in range(levels)])


def prompt_rows(ratings: DataFrame, labels: DataFrame, prompt: str = "prompt", raters: int | None = 3) -> DataFrame:
    """Per prompt of exactly `raters` ratings (None: any number) the median and route, the truth level, local truth and the nested ratings, one a rater."""
    from routecast.functions.expr import solvable, truth_level
    from routecast.operators.panel import prompt_ratings

    nested = ratings.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct("rater", "rating_level", "response_time_ms"))).alias("ratings"))
    l = labels.select(F.col("question_id").alias(prompt), truth_level(F.col("correct_count"), F.col("k")).alias("truth_level"), solvable(F.col("correct_count"), F.col("k")).alias("local_truth"))
    return prompt_ratings(ratings, prompt, raters=raters).join(nested, prompt).join(l, prompt)


def level_use(ratings: DataFrame, level: str = "rating_level", rater: str = "rater", levels: int = 6) -> DataFrame:
    """(level, n, raters) for every level, used or not."""
    grid = ratings.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    use = ratings.groupBy(F.col(level).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(rater).alias("raters"))
    return grid.join(use, "level", "left").na.fill(0, ["n", "raters"])


def transitions(before: DataFrame, after: DataFrame, key: str, level: str) -> DataFrame:
    """(before, after, n) of the level of the same items in two label tables."""
    a, b = before.select(key, F.col(level).alias("before")), after.select(key, F.col(level).alias("after"))
    return a.join(b, key).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def _at(counts: Column, place: Column) -> Column:
    """The level at a 0-based place of an ascending array of (level, n); null if there is none."""
    kind = counts[0].level
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.nullif(kind, kind).alias("level"))
    step = lambda s, x: F.struct((s.upto + x.n).alias("upto"), F.when((s.upto <= place) & (place < s.upto + x.n), x.level).otherwise(s.level).alias("level"))
    return F.aggregate(counts, start, step, lambda s: s.level)


def _medians(counts: Column, total: Column) -> Column:
    """Lower and upper median of an ascending array of (level, n) of `total` in all, a plain column; nulls if all n are 0."""
    return F.struct(_at(counts, F.floor((total - 1) / 2)).alias("lower"), _at(counts, F.floor(total / 2)).alias("upper"))


def _counts(ratings: DataFrame, prompt: str) -> DataFrame:
    """(prompt, counts, total): the ascending (level, n) of each prompt's ratings and how many there are."""
    n = ratings.groupBy(prompt, F.col("rating_level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("counts"), F.sum("n").alias("total"))


def _branches(ratings: DataFrame, truth: DataFrame, prompt: str) -> DataFrame:
    """(prompt, truth_level, lower, upper): lower and upper medians of the ratings that are left, read off their counts by level."""
    g = _counts(ratings, prompt).select(prompt, _medians(F.col("counts"), F.col("total")).alias("m"))
    return g.join(truth.select(prompt, "truth_level"), prompt).select(prompt, "truth_level", "m.*")


def after_removal(ratings: DataFrame, truth: DataFrame, removed: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Descriptors by branch (lower, upper median) without the raters in `removed`; prompts without ratings are left out."""
    b = _branches(ratings.join(removed.select("rater").distinct(), "rater", "left_anti"), truth, prompt)
    long = b.select("truth_level", F.explode(F.array(F.struct(F.lit("lower").alias("branch"), F.col("lower").alias("level")), F.struct(F.lit("upper").alias("branch"), F.col("upper").alias("level")))).alias("x"))
    return pair_descriptors(long.select("truth_level", "x.branch", "x.level"), "truth_level", "level", ["branch"])


def leave_one_out(ratings: DataFrame, truth: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Descriptors by removed rater and branch.

    Ratings of a prompt are counted by level. Without one rating of level m, place i of the sorted levels holds what it held if that is below m, else
    what place i + 1 held, so a rater's rows need four levels of a prompt, however many ratings it has; only a rater who rated a prompt several times is taken
    off the counts. Only prompts that a rater touched change; for all others the cells of the whole table are taken, less those prompts' own.
    A rater who is alone on a prompt takes it out.
    """
    n, counts = F.col("total"), F.col("counts")
    per = _counts(ratings, prompt).join(truth.select(prompt, "truth_level"), prompt)
    held = [_at(counts, F.floor((n + i) / 2)) for i in (-2, 0, -1, 1)]  # at the places of both medians of n - 1, and the next ones
    per = per.select(prompt, "truth_level", "counts", "total", _medians(counts, n).alias("whole"), *[h.alias(f"_{i}") for i, h in enumerate(held)])
    branches = lambda c: F.array(*[F.struct(F.lit(b).alias("branch"), F.col(f"{c}.{b}").alias("level")) for b in ("lower", "upper")])
    base = cells(per.select("truth_level", F.explode(branches("whole")).alias("x")).select("truth_level", "x.branch", "x.level"), "truth_level", "level", ["branch"])
    own = ratings.groupBy(prompt, F.col("rater").alias("removed")).agg(F.min("rating_level").alias("m"), F.count(F.lit(1)).alias("times"), F.count("rating_level").alias("levels"))
    once = salted_join(own.where("times = 1 and levels = 1"), per.drop("counts"), prompt)
    stays = lambda i: F.when(n > 1, F.when(F.col(f"_{i}") >= F.col("m"), F.col(f"_{i + 1}")).otherwise(F.col(f"_{i}")))
    once = once.select("removed", "truth_level", "whole", F.struct(stays(0).alias("lower"), stays(2).alias("upper")).alias("without"))
    again = own.where("times > 1 or levels < 1").select(prompt, "removed").join(ratings.withColumnRenamed("rater", "removed").select(prompt, "removed", "rating_level"), [prompt, "removed"])
    again = again.groupBy(prompt, "removed").agg(F.collect_list("rating_level").alias("mine")).join(per, prompt)
    left = F.transform("counts", lambda x: F.struct(x.level.alias("level"), (x.n - F.size(F.filter("mine", lambda m: m == x.level))).alias("n")))
    again = again.select("removed", "truth_level", "whole", left.alias("counts"), (n - F.size("mine")).alias("total"))
    again = again.select("removed", "truth_level", "whole", _medians(counts, n).alias("without"))
    moved = once.unionByName(again).groupBy("removed", "truth_level", "whole", "without").agg(F.count(F.lit(1)).alias("n"))
    moves = F.array(*[F.struct(F.lit(b).alias("branch"), F.col(f"{c}.{b}").alias("b"), (F.lit(sign) * F.col("n")).alias("n")) for c, sign in (("whole", -1), ("without", 1)) for b in ("lower", "upper")])
    change = moved.select("removed", F.col("truth_level").alias("a"), F.explode(moves).alias("x")).select("removed", "x.branch", "a", "x.b", "x.n").where("b is not null")
    raters = ratings.select(F.col("rater").alias("removed")).distinct()
    each = raters.crossJoin(F.broadcast(base)).select("removed", "branch", "a", "b", "n")  # base: two branches of levels squared cells
    c = each.unionByName(change).groupBy("removed", "branch", "a", "b").agg(F.sum("n").alias("n")).where("n > 0")
    k = weighted_kappa(c, ["removed", "branch"])
    t, s = F.col("a") >= 3, F.col("b") >= 3
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return k.join(c.groupBy("removed", "branch").agg(total(~t & s).alias("fp"), total(t & ~s).alias("fn")), ["removed", "branch"])


def iqr_fences(df: DataFrame, value: str) -> DataFrame:
    """A18 (A17: linear quantiles): rows strictly outside Q1 - 1.5 IQR or Q3 + 1.5 IQR; none if a value is null or there are fewer than four."""
    q = with_quantiles(df.agg(F.count(value).alias("n"), F.count(F.lit(1)).alias("rows")), df, value, {"q1": 0.25, "q3": 0.75})
    q = q.where("n >= 4 and n = rows").select((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    return df.crossJoin(F.broadcast(q)).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))  # one row of fences


def mad_fences(df: DataFrame, value: str, width: float = 2.0) -> DataFrame:
    """Rows outside median +- width * 1.4826 * MAD; none if the MAD is 0, a value is null or there are fewer than four."""
    m = with_quantiles(df.agg(F.count(value).alias("n"), F.count(F.lit(1)).alias("rows")), df, value, {"mid": 0.5}).where("n >= 4 and n = rows")
    away = df.crossJoin(F.broadcast(m)).select("mid", F.abs(F.col(value) - F.col("mid")).alias("away"))  # one row of m
    mad = with_quantiles(m.select("mid"), away, "away", {"mad": 0.5}).where("mad > 0")
    f = mad.select((F.col("mid") - width * 1.4826 * F.col("mad")).alias("low"), (F.col("mid") + width * 1.4826 * F.col("mad")).alias("high"))
    return df.crossJoin(F.broadcast(f)).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))  # one row of fences


def judge_scores(verdicts: DataFrame, consensus: DataFrame, gate: float = 0.8) -> DataFrame:
    """Per judge pi against the human consensus, the 2x2 counts, whether it passes `gate` and whether it is lenient.

    Lenient: at least 8 false matches, and more than twice the human ratio of others to matches (1 without matches) times the false refusals (at least 1).
    """
    j = verdicts.select("key", "judge", (F.col("verdict") == "match").alias("said")).join(consensus.select("key", F.col("match").alias("truth")), "key")
    pi = scotts_pi(j, F.col("truth"), F.col("said"), ["judge"]).select("judge", "n", "pi")
    c = confusion(j, F.col("truth"), F.col("said"), ["judge"]).select("judge", "tn", "fp", "fn", "tp")
    human = consensus.agg(F.coalesce(F.try_divide(F.count_if(~F.col("match")), F.count_if("match")), F.lit(1.0)).alias("_ratio"))
    lenient = (F.col("fp") >= 8) & (F.col("fp") > 2 * F.col("_ratio") * F.greatest(F.col("fn"), F.lit(1)))
    return pi.join(c, "judge").crossJoin(F.broadcast(human)).withColumns({"passes": F.coalesce(F.col("pi") >= gate, F.lit(False)), "lenient": lenient}).drop("_ratio")  # one row


def run_scores(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per run agreement with labels (id, label: keep, drop, borderline), false accepts and rejects; borderline left out."""
    j = decisions.join(labels, "id").where("label <> 'borderline'")
    keep = F.col("label") == "keep"
    return j.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(keep == F.col("kept")).alias("agree"), F.count_if(~keep & F.col("kept")).alias("false_accept"),
                                F.count_if(keep & ~F.col("kept")).alias("false_reject"), F.count_if("kept").alias("kept"))


def flips(decisions: DataFrame) -> DataFrame:
    """(run_a, run_b, n, flips, rate) of items that two runs decide differently. Runs are few."""
    a = decisions.select("id", F.col("run").alias("run_a"), F.col("kept").alias("ka"))
    b = decisions.select("id", F.col("run").alias("run_b"), F.col("kept").alias("kb"))
    g = a.join(b, "id").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ka") != F.col("kb")).alias("flips"))
    return g.withColumn("rate", F.col("flips") / F.col("n"))


def stratified_error(votes: DataFrame, decisions: DataFrame, populations: DataFrame) -> DataFrame:
    """Per stratum population, share, scored, agreeing and no-majority items, and the error weighted over strata with scored items.

    votes (item, vote), decisions (item, stratum, decided), populations (stratum, population).
    """
    m = votes.groupBy("item").agg(majority(F.col("vote")).alias("truth"))
    g = decisions.join(m, "item").groupBy("stratum").agg(F.count("truth").alias("scored"), F.count_if(F.col("truth") == F.col("decided")).alias("agree"), F.count_if(F.col("truth").isNull()).alias("no_majority"))
    j = populations.join(g, "stratum", "left").na.fill(0, ["scored", "agree", "no_majority"])
    one = Window.partitionBy(F.lit(1))  # a row per stratum
    used = F.sum(F.when(F.col("scored") > 0, F.col("population"))).over(one)
    error = F.sum(F.when(F.col("scored") > 0, F.col("population") * (1 - F.col("agree") / F.col("scored")))).over(one) / used
    return j.select("stratum", "population", (F.col("population") / F.sum("population").over(one)).alias("share"), "scored", "agree", "no_majority", error.alias("weighted_error"))


def field_errors(votes: DataFrame, populations: DataFrame, fields: list[str]) -> DataFrame:
    """Per field the population-weighted share of rejected retained items and the decision (pass, repair, revise).

    votes (item, stratum, one vote column per field).
    """
    long = votes.unpivot(["item", "stratum"], fields, "field", "vote")
    m = long.groupBy("field", "stratum", "item").agg(majority(F.col("vote")).alias("ok"))
    g = m.groupBy("field", "stratum").agg(F.count("ok").alias("scored"), F.count_if(~F.col("ok")).alias("wrong")).where("scored > 0")
    w = g.join(populations, "stratum").groupBy("field").agg((F.sum(F.col("population") * F.col("wrong") / F.col("scored")) / F.sum("population")).alias("error"), F.sum("wrong").alias("wrong"))
    return w.withColumn("decision", F.when(F.col("error") <= 0.05, "pass").when(F.col("error") <= 0.10, "repair").otherwise("revise"))


def populations(corpus: DataFrame) -> DataFrame:
    """Per stratum of (score, convertible, stage) rows: population and retained."""
    from routecast.functions.expr import stratum

    s = stratum(F.col("score"), F.col("convertible"), F.col("stage"))
    return corpus.groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("population"), F.count_if("convertible").alias("retained"))
