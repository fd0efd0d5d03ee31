"""Tool-call linking for chat logs (operator 6), in DataFrame functions only.

Calls and results are joined by (conversation, call identifier), calls are ordered topologically by the one call they may refer to,
arguments are validated against schemas, and each linked call is written as canonical JSON: keys sorted, no
spaces, which is how Spark prints a parsed variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, own_columns, written

#: Tool name to parameter to (kind, required); kinds are string, integer, number, boolean, array and object.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False), "after": ("string", False)},
    "lookup": {"key": ("string", True), "depth": ("integer", True), "after": ("string", False)},
    "translate": {"text": ("string", True), "to": ("string", True), "after": ("string", False)},
}
REFERENCE = "after"  # the argument that names a call which must come first
MESSAGE = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>, tool_call_id: string, content: string>"


def tool_messages(conversations: DataFrame) -> DataFrame:
    """A tool log made of plain conversations: (conv_id, turn, role, text) with JSON texts.

    Each user turn becomes a call `c<turn>` of one of three tools, which refers to call `c<turn div 2>`; each assistant turn is the
    result of the call of the turn before. Lengths decide which arguments are left out or of a wrong type. Other roles are left out.
    """
    c = own_columns(conversations, "conv_id", "turn", "role", "text")
    turn, text, n = F.col("turn"), F.col("text"), F.char_length(F.coalesce("text", F.lit("")))
    after = F.when(turn > 0, F.concat(F.lit("c"), F.floor(turn / 2).cast("string"))).alias("after")
    kind = F.pmod(turn, F.lit(3))
    arguments = F.when(kind == 0, F.to_json(F.struct(text.alias("query"), (n % 12).alias("limit"), after))).when(
        kind == 1, F.when(n % 7 == 0, F.to_json(F.struct(text.alias("key"), F.lit("deep").alias("depth"), after))).otherwise(
            F.to_json(F.struct(text.alias("key"), (n % 5).alias("depth"), after)))).otherwise(
        F.to_json(F.struct(text.alias("text"), F.when(n % 5 > 0, F.lit("fr")).alias("to"), after)))
    name = F.when(kind == 0, "search").when(kind == 1, "lookup").otherwise("translate")
    call = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("id"), name.alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (turn - 1).cast("string")).alias("tool_call_id"), text.alias("content")))
    return c.where("role in ('user', 'assistant')").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "assistant").otherwise("tool").alias("role"), F.when(F.col("role") == "user", call).otherwise(result).alias("text"))


def calls_and_results(messages: DataFrame) -> DataFrame:
    """One row per (conv_id, id): turn, name, arguments and n_calls of its call, result_turn, content and n_results of its result; null and 0 where there is none.

    Of several calls or results with one identifier the first by turn counts, and `n_*` tells how many there were. Texts that are
    not such JSON, and entries without an identifier, give nothing. Calls meet results in one aggregate, combined before its shuffle.
    """
    m = own_columns(messages, "conv_id", "turn", "role", "text").where("role in ('assistant', 'tool')").select("conv_id", "turn", "role", F.from_json("text", MESSAGE).alias("m"))
    called = F.transform("m.tool_calls", lambda c, i: F.struct(
        c["id"].alias("id"), F.struct(F.col("turn"), i.alias("at"), c["name"].alias("name"), c["arguments"].alias("arguments")).alias("c"), F.lit(None).cast("struct<turn: bigint, content: string>").alias("r")))
    answered = F.array(F.struct(F.col("m.tool_call_id").alias("id"), F.lit(None).cast("struct<turn: bigint, at: int, name: string, arguments: string>").alias("c"),
                                F.struct(F.col("turn"), F.col("m.content").alias("content")).alias("r")))
    rows = m.select("conv_id", F.explode(F.when(F.col("role") == "assistant", called).otherwise(answered)).alias("e")).where("e.id is not null")
    both = rows.groupBy("conv_id", F.col("e.id").alias("id")).agg(
        F.min("e.c").alias("c"), F.count("e.c").alias("n_calls"), F.min("e.r").alias("r"), F.count("e.r").alias("n_results"))
    return both.select("conv_id", "id", "c.turn", "c.name", "c.arguments", "n_calls", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")


def _meet(left: DataFrame, right: DataFrame, how: str, on: str = "id", by: str = "id") -> DataFrame:
    """Join on (conversation, identifier), null conversations included; the right side's keys become `_conv` and `_id`."""
    others = [F.col(c) for c in right.columns if c not in ("conv_id", by)]
    right = right.select(F.col("conv_id").alias("_conv"), F.col(by).alias("_id"), *others)
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(on) == F.col("_id")), how)


def levels(edges: DataFrame) -> DataFrame:
    """(conv_id, id, level) of each call that refers to another: the length of the chain of references below it; null in and above a cycle.

    `edges` (conv_id, id, needs) has one row per referring call and links existing calls. Pointers double: each round, a call looks
    past its target to the target's own target, so a chain of n calls takes log2(n) rounds. Calls at the end of their chain are looked
    up but look no further, so those that end in one place do not meet there again. A round that brings no further call to the end leaves only cycles.
    """
    p = written(edges.select("conv_id", "id", F.col("needs").alias("to"), F.lit(1).alias("dist"), F.lit(False).alias("ended")))
    done = 0
    while True:
        over = p.select("conv_id", "id", F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("ended").alias("_ended"))
        moved = _meet(p.where("not ended"), over, "left", on="to").select(
            "conv_id", "id", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.coalesce("_ended", F.lit(True)).alias("ended"))
        p = written(p.where("ended").unionByName(moved))
        before, done = done, p.where("ended").count()
        if done == before or p.where("not ended").isEmpty():
            return p.select("conv_id", "id", F.when(F.col("ended"), F.col("dist")).alias("level"))


def _kind(v: Column) -> Column:
    name = F.schema_of_variant(v)
    return F.when(name == "BIGINT", "integer").when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(
        name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").otherwise(F.lower(name))


def violations(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted array of faults of variant `arguments` for tool `name`: arguments, tool, missing:p, type:p and unknown:p."""
    found = F.array(F.lit("tool")).cast("array<string>")
    for tool, params in schemas.items():
        faults = []
        for p, (kind, required) in params.items():
            v = F.try_variant_get(arguments, f"$.{p}", "variant")
            fits = _kind(v).isin("integer", "number") if kind == "number" else _kind(v) == kind
            faults.append(F.when(v.isNull() | F.is_variant_null(v), F.lit(f"missing:{p}") if required else F.lit(None)).when(~fits, F.lit(f"type:{p}")))
        keys = F.array_except(F.json_object_keys(F.to_json(arguments)), F.array(*[F.lit(p) for p in params]))
        extra = F.transform(keys, lambda k: F.concat(F.lit("unknown:"), k))
        found = F.when(name == tool, F.concat(F.array_compact(F.array(*faults)), extra)).otherwise(found)
    usable = arguments.isNotNull() & F.schema_of_variant(arguments).startswith("OBJECT")
    return F.array_sort(F.when(usable, found).otherwise(F.array(F.lit("arguments"))))


def link(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call and per result without a call, with status, order, faults and canonical JSON.

    conv_id, turn, call_id, name, result_turn, status (linked, unanswered, orphan), level, errors (comma-joined, sorted;
    empty if valid) and json. A null conv_id is a conversation of its own. A reference to a missing call
    is the fault `reference` and does not delay; calls in or above a cycle have a null level. An empty log gives no row.
    """
    both = cut(calls_and_results(messages).withColumn("needs", F.try_variant_get(F.try_parse_json("arguments"), f"$.{REFERENCE}", "string")))
    known = both.where("n_calls > 0").select("conv_id", "id")
    edges = cut(_meet(both.where("needs is not null").select("conv_id", "id", "needs"), known, "left_semi", on="needs"))
    met = _meet(both, levels(edges), "left")
    v = F.try_parse_json("arguments")
    faults = F.concat(violations(F.col("name"), v, schemas), F.when(F.col("needs").isNotNull() & F.col("_id").isNull(), F.array(F.lit("reference"))).otherwise(F.array().cast("array<string>")))
    called = F.col("n_calls") > 0
    level = F.when(called, F.when(F.col("_id").isNull(), 0).otherwise(F.col("level")))
    text = F.to_json(F.struct(v.alias("arguments"), F.col("id"), F.col("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    status = F.when(~called, "orphan").when(F.col("n_results") == 0, "unanswered").otherwise("linked")
    return met.select("conv_id", "turn", F.col("id").alias("call_id"), "name", "result_turn", status.alias("status"), level.alias("level"),
                      F.when(called, F.array_join(F.array_sort(faults), ",")).alias("errors"), F.when(called, text).alias("json"))


def op6_tool_calls(conversations: DataFrame) -> DataFrame:
    """`link` of the tool log that `tool_messages` makes of all conversations; null and empty texts are null and empty arguments or results."""
    return link(tool_messages(conversations))


SQL = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text, coalesce(length(text), 0) AS n, turn % 3 AS k, 'c' || turn AS id FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
d AS (SELECT u.*, CASE WHEN u.turn > 0 THEN 'c' || (u.turn // 2) END AS needs, o.turn AS found
  FROM u LEFT JOIN u o ON o.conv_id = u.conv_id AND u.turn > 0 AND o.turn = u.turn // 2),
l AS (SELECT conv_id, turn, 0 AS level FROM d WHERE found IS NULL
  UNION ALL SELECT d.conv_id, d.turn, l.level + 1 FROM d JOIN l ON d.conv_id = l.conv_id AND d.found = l.turn),
j AS (SELECT d.*, '{' || CASE WHEN needs IS NOT NULL THEN '"after":"' || needs || '",' ELSE '' END || CASE k
    WHEN 0 THEN '"limit":' || (n % 12) || ',"query":' || CAST(to_json(text) AS VARCHAR)
    WHEN 1 THEN '"depth":' || CASE WHEN n % 7 = 0 THEN '"deep"' ELSE CAST(n % 5 AS VARCHAR) END || ',"key":' || CAST(to_json(text) AS VARCHAR)
    ELSE '"text":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN n % 5 > 0 THEN ',"to":"fr"' ELSE '' END END || '}' AS args,
  array_to_string(list_sort(list_filter([CASE WHEN k = 2 AND n % 5 = 0 THEN 'missing:to' END, CASE WHEN k = 1 AND n % 7 = 0 THEN 'type:depth' END,
    CASE WHEN needs IS NOT NULL AND found IS NULL THEN 'reference' END], lambda x: x IS NOT NULL)), ',') AS errors,
  CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'translate' END AS name FROM d)
SELECT coalesce(j.conv_id, a.conv_id) AS conv_id, j.turn AS turn, coalesce(j.id, 'c' || (a.turn - 1)) AS call_id, name, a.turn AS result_turn,
  CASE WHEN j.id IS NULL THEN 'orphan' WHEN a.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, CAST(l.level AS INTEGER) AS level,
  CASE WHEN j.id IS NOT NULL THEN coalesce(errors, '') END AS errors,
  CASE WHEN j.id IS NOT NULL THEN '{"arguments":' || args || ',"id":"' || j.id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' END AS json
FROM j FULL OUTER JOIN a ON j.conv_id = a.conv_id AND a.turn = j.turn + 1 LEFT JOIN l ON l.conv_id = j.conv_id AND l.turn = j.turn
"""
