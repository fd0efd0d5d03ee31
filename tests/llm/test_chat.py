import json

from pyspark.sql import functions as F

from routecast.llm import chat

LOG = "conv_id long, turn long, role string, text string"


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a if isinstance(a, str) or a is None else json.dumps(a)} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_order_faults(spark):
    rows = [
        (1, 0, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "lookup", {"key": "k", "depth": "deep", "after": "a"}))),
        (1, 1, "tool", result("a", "found")), (1, 2, "tool", result("zz", "lost")), (1, 3, "tool", result("a", "again")),
        (1, 4, "assistant", call(("c", "translate", {"text": "t", "after": "b", "zeal": {"b": 1, "a": [1.5, None]}}))),
        (2, 0, "assistant", call(("p", "search", {"query": "x", "after": "q"}), ("q", "search", {"query": "x", "after": "p"}), ("r", "search", {"query": "x", "after": "q"}))),
        (3, 0, "assistant", call(("m", "search", "not json"), ("n", "nothing", {}), ("o", "search", "[1]"), ("s", "search", {"query": None, "after": "gone"}), ("t", None, None))),
        (None, 0, "assistant", call(("a", "search", {"query": "é \" \\ \n"}))), (None, 1, "tool", result("a", None)),
        (4, 0, "user", "plain"), (4, 1, "assistant", "plain"), (4, 2, "assistant", None), (4, 3, "tool", "{"), (None, None, None, None),
    ]
    got = {(r.conv_id, r.call_id): r for r in chat.link(spark.createDataFrame(rows, LOG)).collect()}
    assert len(got) == 13
    view = {k: (r.status, r.level, r.errors, r.result_turn) for k, r in got.items()}
    assert view[1, "a"] == ("linked", 0, "", 1)
    assert view[1, "b"] == ("unanswered", 1, "type:depth", None)
    assert view[1, "c"] == ("unanswered", 2, "missing:to,unknown:zeal", None)
    assert view[1, "zz"] == ("orphan", None, None, 2)
    assert view[2, "p"][1] is None and view[2, "q"][1] is None and view[2, "r"][1] is None
    assert view[3, "m"][2] == "arguments" and view[3, "n"][2] == "tool" and view[3, "o"][2] == "arguments" and view[3, "t"][2] == "arguments"
    assert view[3, "s"][1:3] == (0, "missing:query,reference")
    assert view[None, "a"] == ("linked", 0, "", 1)
    assert got[1, "c"].json == '{"arguments":{"after":"b","text":"t","zeal":{"a":[1.5,null],"b":1}},"id":"c","name":"translate","result":null}'
    assert json.loads(got[None, "a"].json)["arguments"] == {"query": 'é " \\ \n'}


def test_repeated_calls_and_empty(spark):
    rows = [(1, 5, "assistant", call(("a", "search", {"query": "late"}))), (1, 2, "assistant", call(("a", "search", {"query": "early"})))] * 2
    df = spark.createDataFrame(rows, LOG)
    got = chat.link(df).collect()
    assert len(got) == 1 and got[0].turn == 2 and "early" in got[0].json
    assert chat.link(df.limit(0)).count() == 0
    assert chat.op6_tool_calls(df.limit(0)).count() == 0


def test_long_chain(spark):
    text = call(*[(f"c{i}", "search", {"query": "x", **({"after": f"c{i - 1}"} if i else {})}) for i in range(6)])
    got = {r.call_id: r.level for r in chat.link(spark.createDataFrame([(1, 0, "assistant", text)], LOG)).collect()}
    assert got == {f"c{i}": i for i in range(6)}


def test_chain_of_thousands_and_a_cycle(spark, monkeypatch):
    """One conversation holds most rows: a chain of 5,000 calls, a cycle with a call above it, a call that needs itself, and 500 calls of one target."""
    ring = [("x", "y"), ("y", "z"), ("z", "x"), ("above", "x"), ("self", "self")]
    calls = [("c0", None), *[(f"c{i}", f"c{i - 1}") for i in range(1, 5000)], *ring, *[(f"w{i}", "c0") for i in range(500)]]
    rows = [(1, n, "assistant", call((i, "search", {"query": "q", **({"after": a} if a else {})}))) for n, (i, a) in enumerate(calls)]
    rows += [(2, 0, "assistant", call(("c0", "search", {"query": "q"})))]
    cuts = []
    for name in ("cut", "written"):
        plain = getattr(chat, name)
        monkeypatch.setattr(chat, name, lambda df, plain=plain: cuts.append(1) or plain(df))
    got = {(r.conv_id, r.call_id): r.level for r in chat.link(spark.createDataFrame(rows, LOG)).collect()}
    assert len(cuts) < 20
    want = {(1, i): int(i[1:]) if i[0] == "c" else 1 if i[0] == "w" else None for i, _ in calls}
    assert got == want | {(2, "c0"): 0}


def test_clashing_columns_and_long_texts(spark):
    long = "x" * 2_000_000
    rows = [(1, 0, "assistant", call(("a", "search", {"query": long, "after": "zz"}))), (1, 1, "tool", result("a", long)), (1, 2, "tool", result("a", long)), (1, 3, "tool", "")]
    df = spark.createDataFrame(rows, LOG)
    for name in ("id", "level", "needs", "_id", "_conv", "to", "dist", "name", "c"):
        df = df.withColumn(name, df.turn)
    got = chat.link(df).collect()
    assert [(r.call_id, r.status, r.level, r.errors) for r in got] == [("a", "linked", 0, "reference")]
    assert json.loads(got[0].json)["result"] == long
    talk = spark.createDataFrame([(None, 0, "user", None), (1, 0, "user", ""), (1, 1, "assistant", long), (1, 2, "user", "q"), (1, None, "user", "q")], LOG).withColumn("m", F.lit(1))
    assert {(r.conv_id, r.call_id): r.status for r in chat.op6_tool_calls(talk).collect()} == {(None, "c0"): "unanswered", (1, "c0"): "linked", (1, "c2"): "unanswered"}


def test_a_long_chain_and_a_star_of_references(spark):
    from routecast.llm.chat import levels

    chain = [("c", f"n{i}", f"n{i - 1}") for i in range(1, 700)]
    star = [("c", f"s{i}", "n3") for i in range(300)] + [("d", "a", "b"), ("d", "b", "a"), ("d", "x", "a"), (None, "n1", "n0")]
    got = {(r.conv_id, r.id): r.level for r in levels(spark.createDataFrame(chain + star, "conv_id string, id string, needs string").repartition(5)).collect()}
    assert all(got["c", f"n{i}"] == i for i in range(1, 700)) and all(got["c", f"s{i}"] == 4 for i in range(300))
    assert got["d", "a"] is got["d", "b"] is got["d", "x"] is None and got[None, "n1"] == 1
