"""Families against a plain union-find, through the operators and the registered queries."""

import hashlib
import json
import unicodedata

import numpy as np
import pytest

from routecast import registry
from routecast.operators import components as C
from routecast.operators import families as FM
from routecast.operators.digests import member_digests

SF = "/root/testdata/sf0.001"
registry.load()


def p10(text):
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def union_find(rows):
    """{id: least id of its family} of (id, text, text, ...) rows."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for column in range(1, len(rows[0])):
        first = {}
        for r in sorted(rows):
            key = p10(r[column])
            if key:
                a, b = find(r[0]), find(first.setdefault(key, r[0]))
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def converted(text):
    return "\n".join(dict.fromkeys(x for x in text.split("\n") if x.strip(" ")))


@pytest.fixture
def rounds(monkeypatch):
    seen, real = [], C.contracted
    monkeypatch.setattr(C, "contracted", lambda links: seen.append(1) or real(links))
    return seen


def test_shuffled_chain_and_star(spark, rounds):
    """A chain of 4,096 nodes and a star of 3,000, under shuffled names."""
    r = np.random.default_rng(3)
    names = [int(x) for x in r.permutation(20_000)[:7097]]
    chain, star = names[:4096], names[4096:]
    links = list(zip(chain, chain[1:])) + [(star[0], x) for x in star[1:]] + [(7, None)]
    got = {x.node: x.root for x in C.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {**dict.fromkeys(chain, min(chain)), **dict.fromkeys(star, min(star))}
    assert len(rounds) < 16


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    r = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))]
    rows = [(i,) for i in {x for link in links for x in link}]
    parent = {i: i for (i,) in rows}
    for _ in range(300):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {x.node: x.root for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: p for i, p in parent.items() if any(i in link and link[0] != link[1] for link in links)}
    assert C.components(spark.createDataFrame(links, "a long, b long").where("false")).count() == 0


def test_texts_in_any_script(spark):
    rows = [(1, "Привет ok мир", "a"), (2, "Другой ok текст", "b"), (3, "Invoice 17", "c"), (4, "invoice 18", "d"), (5, "ПРИВЕТ  OK\tМИР", "e"), (6, "Straße", None), (7, "STRASSE", ""), (8, "ﬁn", " "), (9, "FIN", None),
            (10, None, None), (11, " ", "E"), (12, "a", None), (13, "invoice 18", "A")]
    got = {r.id: r.family for r in FM.families(spark.createDataFrame(rows, "id long, text string, converted string"), "id", ["text", "converted"]).collect()}
    assert got == union_find(rows)
    assert got[1] == got[5] == 1 and got[2] == 2 and got[3] == 3 and got[4] == got[13] == 1 and got[6] == got[7] and got[8] == got[9] and got[10] == 10
    assert got[12] == 12  # an original does not meet a conversion


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "Y "), (None, "x"), (3, None), (3, None)], "id long, t string")
    assert sorted((tuple(r) for r in FM.families(df, "id", ["t"]).collect()), key=str) == [(1, 1), (2, 1), (3, 3), (None, None)]
    assert FM.families(df.where("false"), "id", ["t"]).count() == 0


def test_registered_queries(spark):
    docs = [(r.doc_id, r.text, converted(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    family = union_find(docs)
    members = {}
    for i, f in family.items():
        members.setdefault(f, []).append(i)
    rows = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()))
    assert rows("families") == sorted(family.items()) and len(members) < len(docs)
    assert rows("family_ids") == sorted((f, len(m), hashlib.sha256(json.dumps(sorted(m), separators=(",", ":")).encode()).hexdigest()) for f, m in members.items())
    tested = {f for i, f in family.items() if i % 10 <= 1}
    assert rows("leak_free_split") == sorted((i, f) for i, f in family.items() if i % 10 > 1 and f not in tested)
    role = lambda i: "test" if i % 10 <= 1 else "validation" if i % 10 == 2 else "train"
    assert rows("family_crossings") == sorted((f, n) for f, m in members.items() if (n := len({role(i) for i in m})) > 1)
    assert rows("normalised_families") == sorted(union_find([d[:2] for d in docs]).items())


def test_digests_of_groups(spark):
    """One group has most rows and passes in many small batches; keys are strings with quotes and nulls."""
    names = ['a"b', "é\n", None, "z", "\\", "a"]
    rows = [("hot", f"{names[i % 6]}{i}" if names[i % 6] is not None else None) for i in range(5000)] + [("few", "x"), (None, "y"), ("none", None), ("few", "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.g: (r.n, r.digest) for r in member_digests(spark.createDataFrame(rows, "g string, k string").repartition(5), "g", "k", "n", "digest").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g, k in rows:
        want.setdefault(g, []).append(k)
    digest = lambda ks: hashlib.sha256(json.dumps(sorted((k for k in ks if k is not None), key=lambda k: k.encode()), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got == {g: (len(ks), digest(ks)) for g, ks in want.items()}
