"""Queries on tables of more rows than the given ones, where a table is read and written in parts."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from routecast import registry
from routecast.functions.text import normal_key
from routecast.operators import checks as C
from routecast.operators import families as FM
from routecast.plans import streams as P
from routecast.plans.sampling import _two_texts
from routecast.plans.views import SQL, verdicts
from tests.oracle import compare

registry.load()


@pytest.fixture
def made(tmp_path):
    """Writes tables by SQL and gives the folder and a connection with them."""

    def make(**tables):
        con = duckdb.connect()
        for name, sql in tables.items():
            path = f"{tmp_path}/{name}.parquet"
            con.execute(f"COPY ({sql}) TO '{path}'")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        return str(tmp_path), con

    return make


def test_lines_of_a_file_in_parts(spark, made):
    """the sorted lines fill several part files; an id is null."""
    d, con = made(labels="SELECT CASE WHEN i <> 150000 THEN i END AS doc_id, CAST(i % 2 AS INT) AS quality, CAST(i % 3 = 0 AS INT) AS toxic FROM range(-500, 240000) r(i)")
    compare(registry.QUERIES["numbered_records"](spark, d), con, registry.ORACLES["numbered_records"])


def test_first_of_repeated_trials(spark, tmp_path):
    """of the rows of a key the first in the order of files counts, as in the SQL run by one thread, though Spark reads the larger file first."""
    con, path = duckdb.connect(), f"{tmp_path}/lineitem.parquet"
    con.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, rows in (("a", "range(5000)"), ("b", "range(5000, 200000)")):
        con.execute(f"""COPY (SELECT i % 5000 AS l_orderkey, i // 1000 AS l_partkey, 1 AS l_linenumber, CASE i % 3 WHEN 0 THEN 'A' ELSE 'N' END AS l_returnflag, CASE i % 2 WHEN 0 THEN 'O' ELSE 'F' END AS l_linestatus,
            TIMESTAMP '2000-01-01' AS l_shipdate FROM {rows} r(i)) TO '{path}/{name}.parquet'""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    compare(registry.QUERIES["stream_trial_counts"](spark, str(tmp_path)), con, registry.ORACLES["stream_trial_counts"])


def test_trials_without_a_part_of_the_key_or_before_1970(spark, made):
    """Keys that lack one part or the other are not the same, and no trial is late."""
    d, con = made(lineitem="""SELECT CASE WHEN i % 5 <> 0 THEN i % 40 END AS l_orderkey, CASE WHEN i % 7 <> 0 THEN CAST(i % 3 AS INT) END AS l_linenumber, CASE WHEN i % 11 <> 0 THEN i % 23 END AS l_partkey,
        ['A', 'N', 'R', NULL][1 + CAST(hash(i) % 4 AS INT)] AS l_returnflag, ['O', 'F', NULL][1 + CAST(hash(i + 5) % 3 AS INT)] AS l_linestatus,
        CASE WHEN i % 13 <> 0 THEN TIMESTAMP '1965-01-01' + to_days(CAST(i * 7 % 5000 AS INT)) END AS l_shipdate FROM range(3000) r(i)""")
    compare(registry.QUERIES["stream_trial_counts"](spark, d), con, registry.ORACLES["stream_trial_counts"])


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_texts_stay_out_of_python(spark):
    """what Python is given is null for a plain text."""
    df = spark.createDataFrame([(1, "a")], "i int, t string").select(normal_key(F.col("t")).alias("k"))
    assert "_unicode_key(CASE WHEN" in plan(df)


def test_state_in_a_part_for_each_core(spark):
    """streams with state do not take the session's shuffle partitions, of which each costs a second a batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with P._rocks(spark):
            assert spark.conf.get("spark.sql.shuffle.partitions") == str(max(8, spark.sparkContext.defaultParallelism))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fields_are_counted_apart(spark):
    """no row is multiplied by the fields before the first aggregate; nulls are values, but for wildcards."""
    df = spark.createDataFrame([(1, "a", None), (1, "a", 2.0), (1, "b", None), (2, None, 0.0), (2, None, -0.0), (None, "a", None), (None, None, None)], "g int, x string, y double")
    out = C.unstable(df, "g", ["x", "y"])
    assert "Expand" not in plan(out)
    assert {tuple(r) for r in out.collect()} == {(1, "x", 2), (1, "y", 2), (None, "x", 2)}
    wild = C.instruments(df, ["g"], ["x", "y"], wildcard=("y",))
    assert "Expand" not in plan(wild)
    assert {tuple(r) for r in wild.collect()} == {(1, "x", 2), (None, "x", 2)}


def test_verdicts_are_not_sorted(spark, made):
    """F8: verdicts are reduced as numbers, without a sort of texts or a row for each judge; answers without a question or repeat share no key with others, and suppliers may be negative."""
    d, con = made(part="SELECT CAST(i AS BIGINT) AS p_partkey, 'b' AS p_brand, 't' || i % 3 AS p_type, CAST(i AS INT) AS p_size, 'n' AS p_name FROM range(50) r(i)",
                  lineitem="""SELECT CASE WHEN i % 11 <> 0 THEN CAST(i % 60 AS BIGINT) END AS l_partkey, CASE WHEN i % 13 <> 0 THEN CAST(i % 7 AS INT) END AS l_linenumber, CAST(hash(i) % 9 AS BIGINT) - 2 AS l_suppkey,
                      ['A', 'N', 'R', NULL][1 + CAST(hash(i + 7) % 4 AS INT)] AS l_returnflag FROM range(4000) r(i)""")
    v = verdicts(spark, d)
    assert "SortAggregate" not in v._jdf.queryExecution().executedPlan().toString()
    compare(v, con, f"SELECT * FROM ({SQL['verdicts']})")
    for name in ("panel_verdicts", "panel_incomplete", "panel_labels", "panel_fleiss"):
        compare(registry.QUERIES[name](spark, d), con, registry.ORACLES[name])
    assert "count(distinct" not in plan(registry.QUERIES["panel_labels"](spark, d)).lower()


def test_pairs_of_a_design_are_dealt_in_parts(spark):
    """pairs are dealt by prompt into parts that are not merged again; repeated pairs, missing participants and missing prompts count as in a plain loop."""
    rows = [(i * 7 % 5 or None, i * i % 17 or None, "ab"[i % 2]) for i in range(120)] + [(9, 90, None), (9, 90, None), (None, 91, "a"), (8, 92, "c"), (7, 92, "c"), (6, 92, "c"), (6, None, "c")]
    df = spark.createDataFrame(rows, "participant_id int, prompt_id int, category string")
    out = C.design_faults(df, 3, 2)
    assert plan(out).count("RepartitionByExpression [prompt_id") == 1
    pairs, cells = Counter((p, q) for p, q, _ in rows), Counter((p, c) for p, _, c in rows)
    raters = {q: {p for p, other in pairs if other == q and p is not None} for _, q in pairs}
    want = {"repeated_prompt": sum(n > 1 for n in pairs.values()), "category_count": sum(n != 2 for n in cells.values()), "rater_count": sum(len(p) != 3 for p in raters.values())}
    assert dict(out.collect()) == {k: n for k, n in want.items() if n}
    assert C.design_faults(df.where("participant_id = 100"), 3, 2).collect() == []
    assert C.design_faults(df.where("prompt_id = 92"), 3, 1).collect() == []


def test_a_text_has_its_key_made_once(spark, made, monkeypatch):
    """no filter repeats the keys' expression, an item's equal texts have one key, and texts without repeated lines, blank ones or not, are not converted."""
    seen, real = [], FM.written
    monkeypatch.setattr(FM, "written", lambda df: seen.append(df) or real(df))
    rows = [(1, "Ä a", "Ä a"), (2, "ä  A", None), (3, None, "ä a"), (4, "x", "y"), (5, "y", "x"), (6, None, None), (7, " ", "\n"), (8, "", "")]
    got = {r.id: r.family for r in FM.families(spark.createDataFrame(rows, "id int, text string, converted string"), "id", ["text", "converted"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    texts = ["a\n\nB", "a\n  \nb", "A\nb\n", "a\nb\na", "c\n \nc\nü", "C\nÜ", "c\nc\nü", "\n \n", "", None, "a b", "a\n\t\n\t\nb", "ß\nß", "ss"]
    d, con = made(documents="SELECT CAST(i % 11 AS BIGINT) AS doc_id, " + "[" + ", ".join("NULL" if t is None else "'" + t.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for t in texts) + f"][1 + i] AS text FROM range({len(texts)}) r(i)")
    for name in ("families", "leak_free_split", "family_crossings", "family_ids", "text_links"):
        compare(registry.QUERIES[name](spark, d), con, registry.ORACLES[name])
    # ids 0 to 2 have two texts
    same = _two_texts(spark, d).where("text = converted")
    assert {r.doc_id for r in same.collect()} >= {0, 1, 2, 10}
