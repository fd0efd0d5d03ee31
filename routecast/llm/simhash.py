"""SimHash fingerprints, the search by permuted block tables (operator 1) and near-duplicate classes (operator 7).

Everything here is DataFrame code. A text becomes word shingles (repeats included, so a term weighs as
often as it occurs); the XXH64 of each shingle votes on 64 signed bits. The votes are counted two to a
long: lane j of `h >>> j & 0x100000001` holds bits j and j + 32, so 32 sums do the work of 64 and Spark's
hash aggregation combines them where the text was read. A lane holds 2^31 votes, more than a string can cause.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, own_columns, salted_join, words_of
from .components import components

LANES = 0x100000001
LOW = 0xFFFFFFFF


def _fingerprint(votes: list[str], total: str) -> Column:
    bits = []
    for j, name in enumerate(votes):
        low = F.col(name).bitwiseAND(F.lit(LOW))
        high = F.shiftrightunsigned(F.col(name), 32)
        bits += [F.shiftleft((F.lit(2) * c > F.col(total)).cast("long"), k) for c, k in ((low, j), (high, j + 32))]
    return F.coalesce(reduce(lambda a, b: a.bitwiseOR(b), bits), F.lit(0).cast("long"))


def simhash(df: DataFrame, keys: list[str], text: str, width: int = 3, out: str = "fingerprint") -> DataFrame:
    """`keys` plus a 64-bit fingerprint of the words of column `text`, one row for each distinct `keys`.

    `keys` must tell rows apart. Shingles have `width` words joined by spaces; a text with fewer words is
    one shingle, a text without words (or null) has fingerprint 0. A bit is set if more than half the
    shingle hashes have it. If `df` is already partitioned by some of the keys, nothing is shuffled.
    """
    base = df.select(*keys, words_of(F.col(text)).alias("_w"))
    at = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.greatest(F.size("_w") - width, F.lit(0))))
    rows = base.select(*keys, "_w", F.explode_outer(at).alias("_i"))
    parts = [F.get(F.col("_w"), F.col("_i") + k) for k in range(width)]
    rows = rows.select(*keys, F.when(F.col("_i").isNotNull(), F.xxhash64(F.concat_ws(" ", *parts))).alias("_h"))
    votes = [f"_v{j}" for j in range(32)]
    sums = [F.sum(F.shiftrightunsigned(F.col("_h"), j).bitwiseAND(F.lit(LANES))).alias(v) for j, v in enumerate(votes)]
    done = rows.groupBy(*keys).agg(F.count("_h").alias("_n"), *sums)
    return done.select(*keys, _fingerprint(votes, "_n").alias(out))


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits stands for, from 0 (unrelated) to 1 (equal)."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(pi / 64)))


def _block_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_for(n: int, radius: int, most: int = 12) -> int:
    """The fewest blocks, from two more than the radius, with which a table of n fingerprints has few under one key: keys of log2(n) - 2 bits or more."""
    return next((b for b in range(radius + 2, most) if 64 * (b - radius) / b >= max(1, n).bit_length() - 2), most)


def within_radius(rows: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs (`query`, `fingerprint`, `bits`) of distinct fingerprints at most `radius` bits apart.

    Permuted block tables: 64 bits are cut into `blocks` blocks; `radius` differing bits leave at least
    `blocks - radius` blocks untouched, so each choice of that many blocks is one table, keyed by those
    bits, and a near fingerprint shares a key with the query in one table at least. Pairs found are verified and
    reported once. Both frames need a long column `fingerprint`; nulls never match. With 5 blocks a
    table's key has about 25 bits, with 7 about 36: take more blocks for more rows.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be smaller than blocks")
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(_block_masks(blocks, radius))])

    def tables(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").cast("long").alias(name)).where(F.col(name).isNotNull()).distinct()
        return one.select(name, F.explode(masks).alias("x")).select(
            name, F.col("x.t").alias("t"), F.col(name).bitwiseAND(F.col("x.m")).alias("key"))

    found = tables(queries, "query").join(tables(rows, "fingerprint"), ["t", "key"])
    bits = distance(F.col("query"), F.col("fingerprint"))
    return found.where(bits <= radius).select("query", "fingerprint", bits.alias("bits")).distinct()


def ball(half: int) -> list[int]:
    """Masks of at most `half` of 64 bits, as signed longs."""
    out = [sum(1 << b for b in c) for n in range(half + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (`a`, `b`), a < b, that connect every two fingerprints at most `radius` bits apart.

    Meet in the middle: each fingerprint emits all variants within half the radius; two near ones meet in
    a variant. All that meet in one are linked to its least member (a star, never all pairs). For an even radius
    that loses no connection: members of one variant are at most `radius` apart. A variant has at most as
    many members as the ball has masks (65 for radius 2), however large the input.
    """
    if radius % 2:
        raise ValueError("an even radius is needed: variants of half the radius meet exactly")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = distinct.select(F.col("fingerprint").alias("b"), F.explode(masks).alias("m"))
    variants = variants.select("b", F.col("b").bitwiseXOR(F.col("m")).alias("variant"))
    least = F.min("b").over(Window.partitionBy("variant"))
    met = variants.select("b", least.alias("a")).where("a < b")
    return met.where(distance(F.col("a"), F.col("b")) <= radius).distinct()


def classified(docs: DataFrame, radius: int = 2, width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, fingerprint, root (the class, by its least fingerprint) and component_id; see `near_classes`."""
    rows = own_columns(docs, "doc_id", "text", *keep).select(
        "doc_id", *keep, F.monotonically_increasing_id().alias("_row"), lower_ascii(F.col("text")).alias("text"))
    prints = cut(simhash(rows, ["_row", "doc_id", *keep], "text", width).select("doc_id", *keep, "fingerprint"))
    classes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(ball_links(classes.select("fingerprint"), radius))
    classes = cut(classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        classes["fingerprint"], "first", F.coalesce("root", classes["fingerprint"]).alias("root")))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    member = cut(salted_join(classes, least, "root").select("fingerprint", "root", "component_id"))
    return salted_join(prints, member, "fingerprint").select("doc_id", *keep, "fingerprint", "root", "component_id")


def near_classes(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (long) and component_id, the least doc_id reachable by links.

    Lower-cases A-Z only. Equal fingerprints form one class before any link is searched, so copies cost
    one row each. Null texts count as empty (fingerprint 0, linked like any other). Null doc_ids keep a
    row; a component whose doc_ids are all null has component_id null. Repeated rows are kept. A class or fingerprint that holds
    most rows is dealt over several tasks wherever it is joined.
    """
    return classified(docs, radius, width).select("doc_id", "fingerprint", "component_id")


def next_text(docs: DataFrame, rows_per_bucket: int = 512, most_buckets: int = 32_768, most_ranges: int = 2_048) -> DataFrame:
    """Each document beside its follower in descending doc_id order (after the last comes the first).

    Returns `_b`, `_r` (bucket and place in it, together unique), `_halo`, doc_id, text and `next`, still
    partitioned by `_b`. Buckets are quantiles of the order, so outlying, clustered or null ids do no harm: the narrow keys
    (doc_id and 64 characters of the text) are sorted in at most `most_ranges` ranges, every so-manieth key of a range begins a bucket, and rows find
    their bucket by these keys. At most `most_buckets` + `most_ranges` of them come to the driver, and some 100 sampled keys a range, whatever the size. The first row of a bucket is copied into the one before as a halo row, so the text is shuffled once and no
    window spans the table. Equal doc_ids are ordered by text, null doc_ids come last, a null text counts as empty. Rows that share
    doc_id and their first 64 characters share a bucket.
    """
    d = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("i"), F.substring("text", 1, 64).alias("p"))
    rows = d.count()
    step = max(rows_per_bucket, -(-rows // most_buckets))
    ranged = d.select(key.alias("k")).select("k.*").repartitionByRange(max(1, min(most_ranges, rows // (16 * step))), "n", "i", "p")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its sorted range
    lows = sorted({(r.n, r.i, r.p) for r in ranged.sortWithinPartitions("n", "i", "p").withColumn("_at", place).where(F.col("_at") % step == 0).collect()})
    if not lows:
        return d.select(F.lit(0).alias("_b"), F.lit(0).alias("_halo"), "doc_id", "text", F.lit(0).alias("_r"), F.lit("").alias("next"))
    wide = max(1, round(len(lows) ** 0.5))
    named = [{"n": n, "i": i, "p": p} for n, i, p in lows]
    blocks = F.from_json(F.lit(json.dumps([named[i:i + wide] for i in range(0, len(lows), wide)])), "array<array<struct<n: boolean, i: bigint, p: string>>>")
    d = d.withColumn("_k", key).withColumn("_c", F.size(F.filter(blocks, lambda block: block[0] <= F.col("_k"))) - 1)
    d = d.withColumn("_block", F.get(blocks, F.col("_c"))).withColumn("_f", F.size(F.filter("_block", lambda low: low <= F.col("_k"))) - 1)
    b, first = F.col("_c") * wide + F.col("_f"), F.get("_block", F.col("_f")) == F.col("_k")
    own = F.struct(b.cast("int").alias("b"), F.lit(0).alias("h"))
    halo = F.struct(F.pmod(b - 1, F.lit(len(lows))).cast("int").alias("b"), F.lit(1).alias("h"))
    d = d.select("doc_id", "text", F.explode(F.when(first, F.array(own, halo)).otherwise(F.array(own))).alias("p")).select(
        F.col("p.b").alias("_b"), F.col("p.h").alias("_halo"), "doc_id", "text")
    w = Window.partitionBy("_b").orderBy("_halo", F.col("doc_id").desc_nulls_last(), "text")
    return d.select("*", F.row_number().over(w).alias("_r"), F.lead("text").over(w).alias("next"))


def edited_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp and next_fp for each document and its edited text.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document in descending doc_id order. One shuffle of the text serves both neighbours and fingerprints.
    An empty table gives an empty result; a single document is its own follower.
    """
    t = next_text(docs)
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - div_n)"), F.expr("substring(next, 1, div_n)"))
    t = t.withColumn("div_n", k).withColumn("edited", F.when(F.col("_halo") == 0, edited))
    t = t.select("_b", "_r", "_halo", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                 F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    t = t.select("_b", "_r", "_halo", "doc_id", "n_chars", "edited_sha256", F.col("x.kind").alias("kind"), F.lower("x.text").alias("text"))
    t = t.where("_halo = 0 or kind = 0")
    keys = ["_b", "_r", "_halo", "doc_id", "n_chars", "edited_sha256"]
    fp = simhash(t, [*keys, "kind"], "text", width)
    fp = fp.groupBy(*keys).agg(F.max(F.expr("if(kind = 0, fingerprint, null)")).alias("fp"),
                               F.max(F.expr("if(kind = 1, fingerprint, null)")).alias("edited_fp"))
    after = F.lead("fp").over(Window.partitionBy("_b").orderBy("_r"))
    return fp.select("*", after.alias("next_fp")).where("_halo = 0").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def op1_fingerprints(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """The digest of operator 1 over all documents, with the search run for every `every`-th doc_id.

    `n_near` counts the other rows within `radius` bits of a query row (doc_id divisible by `every`) and is null elsewhere.
    """
    t = cut(edited_fingerprints(docs))
    count = t.groupBy(F.col("fp").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    asked, others = t.where(asks), t.where(~asks).withColumn("n_near", F.lit(None).cast("long"))
    near = within_radius(count, asked.select(F.col("fp").alias("fingerprint")), radius, blocks_for(count.count(), radius)).join(count, "fingerprint")
    near = near.groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    t = salted_join(asked, near.withColumnRenamed("query", "fp"), "fp").select(*others.columns).unionByName(others)
    return t.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")


def op7_near_dedup(docs: DataFrame) -> DataFrame:
    """`near_classes` of all documents at 2 bits on 3-word shingles; null and blank texts share fingerprint 0, repeated rows keep a row each."""
    return near_classes(docs, radius=2, width=3).select("doc_id", hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")
