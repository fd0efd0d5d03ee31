"""Scalar expressions of the evaluation study, as functions of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 6
#: Wording that points at answer options, and answers that may not stand alone.
LIST_STYLE_PREFIX = "which of the following"
DANGLING = r"(?i)\b(?:of the following|of these|following statements|statements above|listed above|options above)\b"
BARE_NUMBER = r"^[-+]?[\d.,]+$"
SENTENCE_FRAGMENT = r"(?i)^(?:and|or|but|which|that|because|greater|less|more)\b"
#: Codes of free background answers (field, answer, value, status, reason).
BACKGROUND_CODES = [
    ("education", "high school diploma, currently studying for a state examination degree", 0.0, "coded", "explicit_self_reported_qualification"),
    ("education", "high school degree", 0.0, "coded", "explicit_self_reported_qualification"),
    ("education", "bachelor's", 1.0, "coded", "explicit_self_reported_qualification"),
    ("education", "bachelor degree", 1.0, "coded", "explicit_self_reported_qualification"),
    ("education", "bachelor", 1.0, "coded", "explicit_self_reported_qualification"),
    ("education", "bachelor´s", 1.0, "coded", "explicit_self_reported_qualification"),
    ("education", "bachlors", 1.0, "coded", "explicit_self_reported_qualification"),
    ("education", "master", 2.0, "coded", "explicit_self_reported_qualification"),
    ("education", "master's", 2.0, "coded", "explicit_self_reported_qualification"),
    ("education", "state examination (lehramt an gymnasien, bavaria), m.ed. equivalent", 2.0, "coded", "explicit_self_reported_qualification"),
    ("education", "3rd year bachelor", None, "missing", "current_study_only_no_completed_qualification"),
    ("education", "cs bachelor student", None, "missing", "current_study_only_no_completed_qualification"),
    ("education", "doing my bachelor", None, "missing", "current_study_only_no_completed_qualification"),
    ("education", "school", None, "ambiguous", "ambiguous_school_label"),
    ("education", "secondary education", None, "ambiguous", "ambiguous_school_label"),
    ("student", "student", 1.0, "coded", "explicit_student_or_mixed_student_status"),
    ("student", "phd-student", 1.0, "coded", "explicit_student_or_mixed_student_status"),
    ("student", "phd student", 1.0, "coded", "explicit_student_or_mixed_student_status"),
    ("student", "student & employee", 1.0, "coded", "explicit_student_or_mixed_student_status"),
    ("student", "student and employee", 1.0, "coded", "explicit_student_or_mixed_student_status"),
    ("student", "working student", 1.0, "coded", "explicit_student_or_mixed_student_status"),
    ("student", "employee", 0.0, "coded", "explicit_employee_only_status"),
    ("student", "employed", 0.0, "coded", "explicit_employee_only_status"),
    ("usage", "less than weekly", 0.0, "coded", "frozen_ordinal_usage_category"),
    ("usage", "1–2 days/week", 1.0, "coded", "frozen_ordinal_usage_category"),
    ("usage", "3–4 days/week", 2.0, "coded", "frozen_ordinal_usage_category"),
    ("usage", "5–6 days/week", 3.0, "coded", "frozen_ordinal_usage_category"),
    ("usage", "daily", 4.0, "coded", "frozen_ordinal_usage_category"),
    ("gender", "female", 0.0, "coded", "binary_univariate_sensitivity_code"),
    ("gender", "male", 1.0, "coded", "binary_univariate_sensitivity_code"),
]
#: The reason given to answers that no code covers.
BACKGROUND_DEFAULTS = {
    "education": "education_value_not_in_frozen_dictionary",
    "student": "occupation_not_explicitly_student_or_employee_only",
    "usage": "usage_value_not_in_frozen_dictionary",
    "gender": "gender_value_not_in_frozen_sensitivity_dictionary",
}
RATING_TRUE, RATING_FALSE = ("True", "TRUE"), ("False", "FALSE")


def truth_level(c: Column, k: Column, levels: int = LEVELS) -> Column:
    """The level of c successes in k trials, in whole numbers; null if k is 0."""
    return F.when(k > 0, F.least(F.floor((c * levels) / k), F.lit(levels - 1))).cast("int")


def probability_level(p: Column, levels: int = LEVELS) -> Column:
    """P2."""
    return F.least(F.floor(p * levels), F.lit(levels - 1)).cast("int")


def solvable(c: Column, k: Column) -> Column:
    """At least half succeed."""
    return c * 2 >= k


def routed(p: Column, threshold: float | Column = 0.5) -> Column:
    """Kept local; the threshold itself is kept."""
    return p >= threshold


def list_style(text: Column) -> Column:
    """P5."""
    return F.lower(F.trim(text)).startswith(LIST_STYLE_PREFIX)


def dangling(text: Column) -> Column:
    """P6."""
    return text.rlike(DANGLING)


def leaks(answer: Column, rewrite: Column, original: Column) -> Column:
    """The answer, of 8 characters or more, is in the rewrite and was not in the original."""
    a = F.lower(F.trim(answer))
    return (F.length(a) >= 8) & F.contains(F.lower(rewrite), a) & ~F.contains(F.lower(original), a)


def suspect(answer: Column) -> Column:
    """Why an answer may not stand alone, or an empty text."""
    a = F.trim(answer)
    words = F.size(F.filter(F.split(a, r"\s+"), lambda w: w != ""))
    return F.when(a.rlike(BARE_NUMBER), "bare_number").when(a.rlike(SENTENCE_FRAGMENT), "fragment").when(
        (words <= 2) & (F.length(a) <= 12), "very_short").otherwise("")


#: Inline and display mathematics between dollars, and signs that only mathematics has.
DISPLAY_MATH = r"(?s)\$\$(.+?)\$\$"
INLINE_MATH = r"(?<!\$)\$(?!\$)[^$\n]+?\$(?!\$)"
MATH_SIGNS = r"[\\^_=]"


def math_delimiters(text: Column) -> Column:
    """`$$x$$` to `\\[x\\]`, and `$x$` to `\\(x\\)` where x does not start with a digit or has one of `\\ ^ _ =`.

    Dollars pair up from the left, whether a pair is changed or not, so of `$5 and $x$` nothing is mathematics.
    """
    display = F.regexp_replace(text, DISPLAY_MATH, r"\\[$1\\]")

    def changed(pair: Column) -> Column:
        inside = F.substring(pair, F.lit(2), F.length(pair) - 2)
        looks = inside.rlike(r"(?U)^\s*[^\s\d]") | (inside.rlike(r"(?U)\S") & inside.rlike(MATH_SIGNS))
        return F.when(looks, F.concat(F.lit("\\("), inside, F.lit("\\)"))).otherwise(pair)

    between, pairs = F.split(display, INLINE_MATH, -1), F.regexp_extract_all(display, F.lit(INLINE_MATH), F.lit(0))
    rest = F.transform(pairs, lambda p, i: F.concat(changed(p), F.get(between, i + 1)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(rest, ""))


def repaired_json(text: Column) -> Column:
    """Doubles the backslash of a command, drops it before a sign that needs none, keeps valid escapes."""
    kept = F.regexp_replace(text, r"\\\\", "\u0001")
    bare = F.regexp_replace(kept, r"\\(?=[$%&#_])", "")
    doubled = F.regexp_replace(bare, r'\\(?![\\"/nrtu])', r"\\\\")
    return F.regexp_replace(doubled, "\u0001", r"\\\\")


def prompt(question: Column, options: Column) -> Column:
    """The question and its options, lettered from A."""
    lines = F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"))


def blind_id(place: Column, width: int = 3) -> Column:
    """P13."""
    return F.format_string(f"A%0{width}d", place)


def item_key(question_id: Column, rep: Column) -> Column:
    """P14."""
    return F.concat_ws(":", question_id.cast("string"), rep.cast("string"))


def slug(text: Column) -> Column:
    """P15."""
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def ungradable(response: Column) -> Column:
    """Nothing visible to grade."""
    return F.coalesce(response, F.lit("")).rlike(r"(?U)^\s*$")


def coded_background(df: DataFrame, field: str = "field", raw: str = "raw") -> DataFrame:
    """Adds value, status and reason to rows of (field, raw); the code table is fixed and broadcast."""
    spark = df.sparkSession
    codes = spark.createDataFrame(BACKGROUND_CODES, "_field string, _answer string, _value double, _status string, _reason string")
    norm = F.lower(F.trim(F.coalesce(F.col(raw), F.lit(""))))
    j = df.withColumn("_norm", norm).join(F.broadcast(codes), (F.col(field) == F.col("_field")) & (F.col("_norm") == F.col("_answer")), "left")
    age = F.col("_norm").try_cast("double")
    fits = (age > 0) & (age <= 120)
    default = reduce(lambda a, f: a.when(F.col(field) == f, BACKGROUND_DEFAULTS[f]), BACKGROUND_DEFAULTS, F.when(F.lit(False), ""))
    blank, is_age = F.col("_norm") == "", F.col(field) == "age"
    value = F.when(blank, None).when(is_age, F.when(fits, age)).otherwise(F.col("_value"))
    status = F.when(blank, "missing").when(is_age, F.when(fits, "coded").otherwise("invalid")).otherwise(F.coalesce("_status", F.lit("ambiguous")))
    reason = F.when(blank, "blank_response").when(is_age & age.isNull(), "age_not_numeric").when(is_age & ~fits, "age_not_finite_or_out_of_range").when(
        is_age, "finite_age_in_years").otherwise(F.coalesce(F.col("_reason"), default))
    return j.select(*df.columns, value.alias("value"), status.alias("status"), reason.alias("reason"))


def reversed_votes(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Swaps yes and no of the (rater, field) pairs in `corrections`; adds `reversed`."""
    c = corrections.select(F.col("rater").alias("_r"), F.col("field").alias("_f"))
    j = df.join(c, (F.col("rater") == F.col("_r")) & (F.col("field") == F.col("_f")), "left")
    hit = F.col("_r").isNotNull() & F.col("vote").isin("yes", "no")
    vote = F.when(hit & (F.col("vote") == "yes"), "no").when(hit, "yes").otherwise(F.col("vote"))
    return j.select(*[c for c in df.columns if c != "vote"], vote.alias("vote"), F.coalesce(hit, F.lit(False)).alias("reversed"))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _choose(n: int, k: int) -> float:
    from math import comb

    return float(comb(n, k))


def decoded(logits: Column, head: str, trials: int = 5) -> tuple[Column, Column | None]:
    """(mean success probability, native count distribution) of a head's logits, an array<double>.

    Heads: softmax, twin and softmax_rps (six classes), corn (products of sigmoids), regression and binomial (one
    sigmoid), beta_binomial (two softplus parameters; rising factorials stand for gamma quotients).
    """
    at = lambda i: F.element_at(logits, i + 1)
    if head == "regression":
        return sigmoid(at(0)), None
    if head == "binomial":
        p = sigmoid(at(0))
        return p, F.array(*[F.lit(_choose(trials, c)) * F.pow(p, F.lit(c)) * F.pow(1 - p, F.lit(trials - c)) for c in range(trials + 1)])
    if head == "corn":
        s = [reduce(lambda a, b: a * b, [sigmoid(at(i)) for i in range(j + 1)]) for j in range(trials)]
        pmf = [1 - s[0], *[s[j] - s[j + 1] for j in range(trials - 1)], s[-1]]
        return reduce(lambda a, b: a + b, s) / trials, F.array(*pmf)
    if head == "beta_binomial":
        a, b = softplus(at(0)) + 1e-4, softplus(at(1)) + 1e-4
        rising = lambda x, n: reduce(lambda u, v: u * v, [x + i for i in range(n)], F.lit(1.0))
        pmf = [F.lit(_choose(trials, c)) * rising(a, c) * rising(b, trials - c) / rising(a + b, trials) for c in range(trials + 1)]
        return a / (a + b), F.array(*pmf)
    first = F.slice(logits, 1, trials + 1)
    top = F.array_max(first)
    weight = F.transform(first, lambda x: F.exp(x - top))
    total = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x)
    pmf = F.transform(weight, lambda x: x / total)
    mean = F.aggregate(F.transform(pmf, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x) / trials
    return mean, pmf


def consistent(p: Column, logits: Column, head: str, tolerance: float = 1e-7) -> Column:
    """P20: a stored probability equals the decoded one."""
    return F.abs(p - decoded(logits, head)[0]) <= tolerance


def valid_pmf(pmf: Column, p: Column, k: int = 5, tolerance: float = 1e-7) -> Column:
    """K + 1 probabilities that sum to 1 and whose mean is p."""
    total = F.aggregate(pmf, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.transform(pmf, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x) / k
    return (F.size(pmf) == k + 1) & F.forall(pmf, lambda x: (x >= 0) & (x <= 1)) & (F.abs(total - 1) <= tolerance) & (F.abs(mean - p) <= tolerance)


def stratum(score: Column, convertible: Column, stage: Column) -> Column:
    """P22."""
    return F.when(score.between(4, 7), "borderline").when(convertible, F.when(stage == "judge", "kept_judge").otherwise("kept_rescore")).otherwise(
        F.when(stage == "rewrite", "drop_rewrite").otherwise("drop_rescore"))


def scaled_tokens(mean_tokens: Column, multiplier: Column | float) -> Column:
    """Half up."""
    return F.floor(mean_tokens * multiplier + 0.5)


def identity(ids: Column) -> Column:
    """SHA-256 of a JSON array of sorted ids."""
    return F.sha2(F.to_json(F.array_sort(ids)), 256)


def word_count(text: Column) -> Column:
    """P25: white-space tokens of a text."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def capped(tokens: Column, cap: int = 400) -> Column:
    """P26."""
    return tokens >= cap


def strict_bool(raw: Column) -> Column:
    """Exactly True, TRUE, False or FALSE, else null."""
    return F.when(raw.isin(*RATING_TRUE), True).when(raw.isin(*RATING_FALSE), False)


def strict_int(raw: Column) -> Column:
    """Canonical integer text, else null."""
    return F.when(raw.rlike("^(0|-?[1-9][0-9]*)$"), raw.try_cast("bigint"))


def rating_matches(rating: Column, level: Column, names: list[str]) -> Column:
    """The rating's text is the name of its level."""
    return F.get(F.array(*[F.lit(n) for n in names]), level) == rating
