import hashlib
import math
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.llm import simhash
from routecast.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, lower):
    words = WORD.findall(lower(text or ""))
    n = len(words)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, n - 2))] if n else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def classes(rows):
    prints = [fingerprint(t, ascii_lower) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        a, b, c = (fingerprint(x, str.lower) for x in (t, edited, nxt))
        like = lambda x, y: max(0.0, math.cos(math.pi * (x ^ y).bit_count() / 64))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def got1(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in simhash.op1_fingerprints(df).collect()), key=str)


def test_op1_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got1(documents) == edits(rows)


def test_op1_buckets(documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    small = simhash.next_text
    monkeypatch.setattr(simhash, "next_text", lambda d: small(d, rows_per_bucket=7))
    assert got1(documents) == edits(rows)


def test_op1_odd_rows(make_docs, odd_rows, spark):
    assert got1(make_docs(odd_rows)) == edits(odd_rows)
    assert simhash.op1_fingerprints(make_docs(odd_rows).limit(0)).count() == 0
    assert got1(make_docs([(3, "just one text here")])) == edits([(3, "just one text here")])


def test_op1_ids_of_any_shape(documents, spark, monkeypatch):
    """Outlying, clustered, equal and null ids and one text in a third of the rows still give small buckets."""
    from pyspark.sql import functions as F

    texts = [r.text for r in documents.orderBy("doc_id").limit(90).collect()]
    ids = [10**15, -(2**63), 2**63 - 1, *range(30), *[5] * 20, *[None] * 7, *range(10**9, 10**9 + 30)]
    rows = [(d, texts[i] if i % 3 else texts[0]) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_b", "_k", "n", "i", "p", "fingerprint", "next"):
        df = df.withColumn(name, F.lit(1))
    small = simhash.next_text
    sizes = [r["count"] for r in small(df, rows_per_bucket=5).where("_halo = 0").groupBy("_b").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 15
    monkeypatch.setattr(simhash, "next_text", lambda d: small(d, rows_per_bucket=5))
    assert got1(df) == edits(rows)


def test_components_of_long_paths(spark, monkeypatch):
    """Paths, a star around the greatest node and a ring; the rounds stay logarithmic."""
    import random

    from routecast.llm import components as module

    order = list(range(2000, 2300))
    random.Random(4).shuffle(order)
    links = [(i, i + 1) for i in range(400)] + [(1000 + i, 1500) for i in range(200)] + list(zip(order, order[1:])) + [(3000 + i, 3000 + (i + 1) % 64) for i in range(64)]
    cuts, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df: cuts.append(1) or plain(df))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(401)}, **{1000 + i: 1000 for i in range(200)}, 1500: 1000, **{i: 2000 for i in range(2000, 2300)}, **{3000 + i: 3000 for i in range(64)}}
    assert got == want
    assert len(cuts) < 45


def test_op7_hot_groups(make_docs):
    """Most rows are copies of one text; another group chains near copies."""
    base = " ".join(f"w{i}" for i in range(400))
    near = [(500 + i, base.replace("w7 ", f"w7{i} ")) for i in range(30)]
    rows = [(i, "one very common text that many rows hold") for i in range(400)] + near
    got = sorted((tuple(r) for r in simhash.op7_near_dedup(make_docs(rows)).collect()), key=str)
    assert got == classes(rows)


def test_op1_near_counts(documents):
    rows = [(r.doc_id, fingerprint(r.text, str.lower)) for r in documents.collect()]
    want = {d: sum((f ^ g).bit_count() <= 3 for _, g in rows) - 1 for d, f in rows if d % 50 == 0}
    got = {r.doc_id: r.n_near for r in simhash.op1_fingerprints(documents).collect() if r.doc_id % 50 == 0}
    assert got == want


def test_op7_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted((tuple(r) for r in simhash.op7_near_dedup(documents).collect()), key=str)
    assert got == classes(rows)


def test_op7_odd_rows(make_docs, odd_rows):
    from pyspark.sql import functions as F

    df = make_docs(odd_rows).withColumn("fingerprint", F.lit("x")).withColumn("root", F.lit(1)).withColumn("_w", F.lit(1))
    got = sorted((tuple(r) for r in simhash.op7_near_dedup(df).collect()), key=str)
    assert got == classes(odd_rows)
    assert simhash.op7_near_dedup(df.limit(0)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 2**32))
def test_block_tables_and_ball_against_all_pairs(spark, seed):
    import random

    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(12)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    got = {(x.query, x.fingerprint) for x in simhash.within_radius(df, df, 3).collect()}
    assert got == {(a, b) for a in signed for b in signed if apart(a, b) <= 3}
    links = {(x.a, x.b) for x in simhash.ball_links(df, 2).collect()}
    assert all(apart(a, b) <= 2 for a, b in links)
    reach = {x.node: x.root for x in components(simhash.ball_links(df, 2)).collect()}
    want = {s: s for s in signed}
    for _ in signed:
        for a in signed:
            for b in signed:
                if apart(a, b) <= 2:
                    want[a] = want[b] = min(want[a], want[b])
    assert {s: reach.get(s, s) for s in signed} == want


def test_blocks_grow_with_the_table():
    assert [simhash.blocks_for(n, 3) for n in (0, 1000, 10**8, 10**9, 10**12)] == [5, 5, 5, 6, 8]
