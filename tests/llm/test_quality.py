import re
from collections import Counter

from routecast.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(df, rows):
    got = quality.op4_quality(df).collect()
    assert sorted(tuple(r)[:6] for r in got if r.doc_id is not None) == sorted((d, *measured(t)) for d, t in rows if d is not None)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert len(got) == len(rows)
    return got


def test_documents(documents):
    got = check(documents, [(r.doc_id, r.text) for r in documents.collect()])
    assert sum(r.n_repeat_words > 0 for r in got) > 3
    assert all(r.kept != r.base_failed for r in got)


def test_odd_rows(make_docs, odd_rows):
    from pyspark.sql import functions as F

    rows = [*odd_rows, (40, "a b c d e f g h " * 5), (41, "x\ny\nx\n\n \nx | # <b>")]
    df = make_docs(rows).withColumn("n", F.lit(1)).withColumn("_h", F.lit(2)).withColumn("bad", F.lit(True))
    check(df, rows)
    assert quality.op4_quality(df.limit(0)).count() == 0


def test_bad_host(make_docs):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", f"s{i % 5}") for i in range(100)]
    bad = [(200 + i, "too short", "en", "spam") for i in range(60)]
    lone = [(300, " ".join(f"z{j}" for j in range(30)), "en", "spam"), (301, " ".join(f"q{j}" for j in range(30)), "en", None)]
    got = {r.doc_id: r for r in quality.op4_quality(make_docs(good + bad + lone)).collect()}
    assert all(got[i].kept for i in range(100)) and not any(got[200 + i].kept for i in range(60))
    assert not got[300].kept and not got[300].base_failed and got[301].kept
