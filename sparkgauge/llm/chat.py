"""Chat formatting: tool calls are linked with their results, ordered, validated and written as canonical JSON.

A message is (conv_id, turn, role, text). A text that is a JSON object may hold ``tool_calls``, a list of
``{"id", "name", "arguments"}``; a message of role ``tool`` holds ``{"tool_call_id", "content"}``. All other messages are
plain. An argument may refer to the result of another call of its conversation by ``{"$ref": id}``.

* Linking: calls and results are joined by (conv_id, id), where an id's first call and first result count; the others
  are ``duplicate``. Results without a call are ``orphan``, calls without a result ``open``, and results that stand before
  their call ``early``.
* Order: ``depth`` of a call is 0 without references, else one more than the deepest call it refers to; calls in or
  behind a cycle, and those that refer to unknown ids, have none and are ``unordered``. A result follows its call. Rows
  sorted by (conv_id, order_turn, order_kind, turn, depth) are in topological order.
* Validation: a table of schemas (tool, field, type, required) gives each tool's fields. ``errors`` lists what is missing,
  unknown or of another type; a tool without a schema has no errors but ``unknown tool``.
* JSON: keys sorted by code point, no white space, nulls left out. Other fields of a call or result stay in its JSON. What a
  message holds beside its calls, as ``content``, makes one more row, of status ``message``. Fields ``role`` and ``turn`` of
  a text give way to the columns.

All is native. Only messages that hold JSON are joined, so plain ones never shuffle, and no conversation is gathered: the
result has a row per message, call or both, which any number of tasks can hold. Defined cases: null texts count as plain and
leave ``content`` out; JSON that doesn't parse is plain text; null ids link with nothing; repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

OBJECT = "map<string,variant>"
CALLS = "array<struct<id:string,name:string,arguments:variant>>"
SCHEMAS = "tool string, field string, type string, required boolean"


def schema_table(spark: SparkSession, rows=()) -> DataFrame:
    """Schemas as a table of one row per tool: tool, types (map), needed (array)."""
    df = spark.createDataFrame(list(rows), SCHEMAS)
    return df.groupBy("tool").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("field", "type")))).alias("types"),
        F.array_sort(F.collect_set(F.when(F.col("required"), F.col("field")))).alias("needed"),
    )


def _kind(v: Column) -> Column:
    """The JSON type of a variant."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when((s == "BIGINT"), "integer").otherwise("number")
    )


def _fits(found: Column, asked: Column) -> Column:
    return (found == asked) | ((asked == "number") & (found == "integer"))


def _others(fields: Column, *known: str) -> Column:
    """The sorted keys of an object that are none of ``known``; an empty array if it isn't one."""
    return F.coalesce(F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)))), F.array().cast("array<string>"))


def _whole_json(fields: Column, keys: Column) -> Column:
    """Canonical JSON of the fields named ``keys`` with the columns role and turn."""
    own = F.filter(F.array(F.when(F.col("role").isNotNull(), F.lit("role")), F.when(F.col("turn").isNotNull(), F.lit("turn"))), lambda k: k.isNotNull())
    value = lambda k: F.when(k == "role", F.col("role").cast("variant")).when(k == "turn", F.col("turn").cast("variant")).otherwise(F.element_at(fields, k))
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.concat(keys, own)), lambda k: F.struct(k, value(k)))))


def formatted(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """A row per plain message, call and result: conv_id, turn, role, call_id, status, depth, order_turn, order_kind, errors, json."""
    spark = messages.sparkSession
    schemas = schema_table(spark) if schemas is None else schemas
    m = messages.select("conv_id", "turn", "role", "text")
    looks = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    v = m.where(looks).withColumn("v", F.try_parse_json("text"))
    v = v.withColumn("calls", F.try_variant_get("v", "$.tool_calls", CALLS)).withColumn("answers", F.try_variant_get("v", "$.tool_call_id", "string"))
    has_calls, is_answer = F.coalesce(F.size("calls") > 0, F.lit(False)), F.coalesce(F.col("role") == "tool", F.lit(False)) & F.col("answers").isNotNull()

    none = [F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"), F.lit(0).alias("depth"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_kind"), F.array().cast("array<string>").alias("errors")]
    plain_json = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))
    plain = m.where(~looks).unionByName(v.where(~(has_calls | is_answer)).select(*m.columns))
    plain = plain.select("conv_id", "turn", "role", *none, plain_json.alias("json"))

    fields = F.try_variant_get("v", "$", OBJECT)
    beside = _others(fields, "tool_calls", "role", "turn")
    rest = v.where(has_calls & (F.size(beside) > 0)).select("conv_id", "turn", "role", *none, _whole_json(fields, beside).alias("json")).withColumn("status", F.lit("message"))

    whole_calls = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    calls = v.where(has_calls).select("conv_id", "turn", "role", F.posexplode(F.arrays_zip("calls", whole_calls.alias("whole"))).alias("n", "c"))
    calls = calls.select("conv_id", "turn", "role", "n", F.col("c.calls.id").alias("call_id"), F.col("c.calls.name").alias("name"), F.to_json("c.calls.arguments").alias("args"), F.col("c.whole").alias("whole"))
    more = F.size(_others(F.try_variant_get("whole", "$", OBJECT), "id", "name", "arguments")) > 0
    calls = calls.withColumn("whole", F.when(more, F.to_json("whole")))
    calls = written(calls)
    answers = written(v.where(~has_calls & is_answer).select("conv_id", "turn", "role", F.col("answers").alias("call_id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"), F.when(F.size(_others(fields, "content", "tool_call_id", "role", "turn")) > 0, _whole_json(fields, _others(fields, "role", "turn"))).alias("whole")))

    keys = ["conv_id", "call_id"]
    first_call = calls.groupBy(*keys).agg(F.min(F.struct("turn", "n")).alias("call_at"))
    first_answer = answers.groupBy(*keys).agg(F.min("turn").alias("answer_at"))
    deep = _depths(calls)
    linked = calls.join(first_call, keys, "left").join(first_answer, keys, "left").join(deep, keys, "left").join(small(written(schemas)), F.col("name") == F.col("tool"), "left")
    status = (
        F.when(F.struct("turn", "n") != F.col("call_at"), "duplicate").when(F.col("answer_at").isNull(), "open").when(F.col("answer_at") < F.col("turn"), "early").otherwise("linked")
    )
    arguments = F.from_json("args", "map<string,variant>")
    got = F.coalesce(F.map_keys(arguments), F.array().cast("array<string>"))
    missing = F.transform(F.array_except("needed", got), lambda x: F.concat(F.lit("missing "), x))
    unknown = F.transform(F.array_except(got, F.map_keys("types")), lambda x: F.concat(F.lit("unknown "), x))
    wrong = F.transform(F.filter(F.array_intersect(got, F.map_keys("types")), lambda x: ~_fits(_kind(F.element_at(arguments, x)), F.element_at("types", x))), lambda x: F.concat(F.lit("type "), x))
    errors = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(missing, unknown, wrong)))
    call_json = F.to_json(F.struct("role", F.array(F.struct(F.parse_json("args").alias("arguments"), F.col("call_id").alias("id"), "name")).alias("tool_calls"), "turn"))
    call_json = F.when(F.col("whole").isNull(), call_json).otherwise(F.to_json(F.struct("role", F.array(F.parse_json("whole")).alias("tool_calls"), "turn")))
    call_rows = linked.select(
        "conv_id", "turn", "role", "call_id", F.when(F.col("depth").isNull() & (status != "duplicate"), "unordered").otherwise(status).alias("status"), F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_kind"), errors.alias("errors"), call_json.alias("json"),
    )
    replies = answers.join(first_call, keys, "left").join(first_answer, keys, "left").join(deep, keys, "left")
    reply_status = (
        F.when(F.col("call_at").isNull(), "orphan").when(F.col("turn") != F.col("answer_at"), "duplicate").when(F.col("turn") < F.col("call_at.turn"), "early").otherwise("linked")
    )
    reply_json = F.to_json(F.struct(F.parse_json("content").alias("content"), "role", F.col("call_id").alias("tool_call_id"), "turn"))
    reply_json = F.coalesce("whole", reply_json)
    reply_rows = replies.select(
        "conv_id", "turn", "role", "call_id", reply_status.alias("status"), F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.coalesce("call_at.turn", "turn").alias("order_turn"), F.lit(1).alias("order_kind"), F.array().cast("array<string>").alias("errors"), reply_json.alias("json"),
    )
    return plain.unionByName(rest).unionByName(call_rows).unionByName(reply_rows)


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of all calls that can be ordered."""
    # ``args`` is JSON as Spark writes it, without white space: what stands behind a brace or comma is a key, as quotes in strings are escaped
    raw = F.regexp_extract_all("args", F.lit(r'[{,]"\$ref":("(?:[^"\\]|\\.)*")'), 1)
    refs = F.array_distinct(F.from_json(F.concat(F.lit("["), F.array_join(raw, ","), F.lit("]")), "array<string>"))
    nodes = written(calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min_by(F.coalesce(refs, F.array().cast("array<string>")), F.struct("turn", "n")).alias("refs")))
    done = nodes.where(F.size("refs") == 0).select("conv_id", "call_id", F.lit(0).alias("depth"))
    waiting = nodes.where(F.size("refs") > 0)
    if waiting.isEmpty():
        return done
    edges = written(waiting.select("conv_id", "call_id", F.size("refs").alias("n"), F.explode("refs").alias("ref")))
    done = written(done)

    # chains of calls with one reference: each call's pointer doubles its way a round, up to what has none or several
    jump = written(edges.where("n = 1").select("conv_id", "call_id", "ref", F.lit(1).cast("long").alias("way")))
    longest = jump.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):  # whoever still moves after that is in or behind a cycle
        ahead = jump.select("conv_id", F.col("call_id").alias("ref"), F.col("ref").alias("next"), F.col("way").alias("more"))
        jump = written(jump.join(ahead, ["conv_id", "ref"], "left").select("conv_id", "call_id", F.coalesce("next", "ref").alias("ref"), (F.col("way") + F.coalesce("more", F.lit(0))).alias("way"), F.col("next").isNotNull().alias("moved")))
        if jump.where("moved").isEmpty():
            break
        jump = jump.drop("moved")

    # calls with several references, level by level until none becomes ready
    ends = jump.select("conv_id", F.col("call_id").alias("ref"), F.col("ref").alias("end"), "way")
    several = written(edges.where("n > 1").join(ends, ["conv_id", "ref"], "left").select("conv_id", "call_id", "n", F.coalesce("end", "ref").alias("ref"), (F.coalesce("way", F.lit(0)) + 1).alias("way")))
    while not several.isEmpty():
        ready = several.join(done.select("conv_id", F.col("call_id").alias("ref"), "depth"), ["conv_id", "ref"]).groupBy("conv_id", "call_id")
        ready = ready.agg(F.count("*").alias("have"), F.max("n").alias("n"), F.max(F.col("depth") + F.col("way")).cast("int").alias("depth")).where("have = n")
        new = written(ready.select("conv_id", "call_id", "depth").join(done, ["conv_id", "call_id"], "left_anti"))
        if new.isEmpty():
            break
        done = written(done.unionByName(new))
    chained = jump.join(done.select("conv_id", F.col("call_id").alias("ref"), "depth"), ["conv_id", "ref"])
    return written(done.unionByName(chained.select("conv_id", "call_id", (F.col("depth") + F.col("way")).cast("int").alias("depth"))))


#: Schemas of the queries' tools: tool, field, type, required.
TOOLS = (("find", "q", "integer", True), ("find", "limit", "integer", False), ("sum", "x", "object", True), ("sum", "note", "string", False))


def op8(spark, sf_dir: str) -> DataFrame:
    out = formatted(table(spark, sf_dir, "conversations"), schema_table(spark, TOOLS))
    return out.select("conv_id", "turn", "role", "call_id", "status", "depth", "order_turn", "order_kind", F.size("errors").cast("long").alias("n_errors"), "json")


#: The table has plain messages alone; ``chat_calls`` holds linking, order and validation against SQL.
OP8_SQL = """
SELECT conv_id, turn, role, NULL::VARCHAR AS call_id, 'plain' AS status, 0 AS depth, turn AS order_turn, 0 AS order_kind, 0::BIGINT AS n_errors,
  '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text)::VARCHAR || ',' END || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role)::VARCHAR || ',' END || '"turn":' || turn || '}' AS json
FROM conversations
"""


#: Messages of every conversation of ``chat_calls``: turn, role, text.
CALL_TEXTS = (
    (0, "user", "hello"),
    (1, "assistant", '{"content":"Let me look.","tool_calls":[{"id":"a","name":"find","arguments":{"q":7}},{"id":"b \\"1\\"","name":"sum","arguments":{"x":{"$ref":"a"}}}]}'),
    (2, "tool", '{"tool_call_id":"a","content":[1,2]}'),
    (3, "tool", '{"tool_call_id":"b \\"1\\"","content":"done"}'),
    (4, "tool", '{"tool_call_id":"z","content":0}'),
    (5, "tool", '{"tool_call_id":"a","content":1}'),
    (6, "assistant", '{"tool_calls":[{"id":"p","name":"sum","arguments":{"x":{"$ref":"q"},"y":1}},{"id":"q","name":"sum","arguments":{"x":{"$ref":"p"}}}]}'),
    (7, "assistant", '{"tool_calls":[{"id":"d","name":"sum","arguments":{"x":{"$ref":"b \\"1\\""}}},{"id":"e","name":"find","arguments":{"q":"seven"}},{"id":"f","name":"gone","arguments":{}}]}'),
    (8, "tool", '{"tool_call_id":"e","content":null}'),
)
#: Calls of the chain in the first conversation, each of which refers to the one before.
CHAIN = 200


def call_messages(conversations: DataFrame) -> DataFrame:
    """Conversations with tool calls, one for each of ``conversations``."""
    spark = conversations.sparkSession
    ids = conversations.select("conv_id").distinct()
    texts = F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for t, r, x in CALL_TEXTS])
    first = ids.agg(F.min("conv_id").alias("conv_id")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(CHAIN - 1))))
    argument = F.when(F.col("i") == 0, F.lit('{"q":0}')).otherwise(F.format_string('{"x":{"$ref":"c%d"}}', F.col("i") - 1))
    name = F.when(F.col("i") == 0, "find").otherwise("sum")
    chain = first.select("conv_id", (F.col("i") + 100).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.format_string('{"tool_calls":[{"id":"c%d","name":"%s","arguments":%s}]}', "i", name, argument).alias("text"))
    return ids.select("conv_id", F.inline(texts)).unionByName(chain)


def chat_calls(spark, sf_dir: str) -> DataFrame:
    out = formatted(written(call_messages(table(spark, sf_dir, "conversations"))), schema_table(spark, TOOLS))
    return out.select("conv_id", "turn", "role", "call_id", "status", "depth", F.size("errors").cast("long").alias("n_errors"))


CHAT_CALLS_SQL = (
    "WITH RECURSIVE texts(turn, role, text) AS (VALUES " + ", ".join(f"({t}, '{r}', '{x}')" for t, r, x in CALL_TEXTS) + "),"
    + f"""
m AS (
  SELECT conv_id, turn, role, text FROM (SELECT DISTINCT conv_id FROM conversations), texts
  UNION ALL SELECT (SELECT min(conv_id) FROM conversations), 100 + i, 'assistant', '{{"tool_calls":[{{"id":"c' || i || '","name":"' || CASE WHEN i = 0 THEN 'find","arguments":{{"q":0}}' ELSE 'sum","arguments":{{"x":{{"$ref":"c' || (i - 1) || '"}}}}' END || '}}]}}' FROM range({CHAIN}) r(i)),
j AS (SELECT *, CASE WHEN starts_with(text, '{{') THEN text::JSON END AS o FROM m),
c AS (
  SELECT conv_id, turn, role, x->>'id' AS call_id, x->>'name' AS name, x->'arguments' AS args, x->'arguments'->'x'->>'$."$ref"' AS ref
  FROM (SELECT *, unnest(CAST(o->'tool_calls' AS JSON[])) AS x FROM j WHERE (o->'tool_calls') IS NOT NULL)),
r AS (SELECT conv_id, turn, role, o->>'tool_call_id' AS call_id, row_number() OVER (PARTITION BY conv_id, o->>'tool_call_id' ORDER BY turn) AS n FROM j WHERE (o->'tool_call_id') IS NOT NULL),
d AS (SELECT conv_id, call_id, 0 AS depth FROM c WHERE ref IS NULL UNION ALL SELECT c.conv_id, c.call_id, depth + 1 FROM c JOIN d ON c.conv_id = d.conv_id AND c.ref = d.call_id),
e AS (
  SELECT conv_id, call_id, CASE name
    WHEN 'find' THEN (CASE WHEN (args->'q') IS NULL OR json_type(args->'q') NOT IN ('UBIGINT', 'BIGINT') THEN 1 ELSE 0 END)
    WHEN 'sum' THEN (CASE WHEN (args->'x') IS NULL THEN 1 ELSE 0 END) + (CASE WHEN (args->'y') IS NULL THEN 0 ELSE 1 END) ELSE 1 END AS n_errors FROM c)
SELECT conv_id, turn, role, NULL::VARCHAR AS call_id, 'plain' AS status, 0 AS depth, 0::BIGINT AS n_errors FROM j WHERE o IS NULL
UNION ALL SELECT conv_id, turn, role, NULL, 'message', 0, 0 FROM j WHERE (o->'tool_calls') IS NOT NULL AND (o->'content') IS NOT NULL
UNION ALL SELECT c.conv_id, c.turn, c.role, c.call_id, CASE WHEN depth IS NULL THEN 'unordered' WHEN a.n IS NULL THEN 'open' WHEN a.turn < c.turn THEN 'early' ELSE 'linked' END, COALESCE(depth, -1), n_errors
  FROM c LEFT JOIN d ON c.conv_id = d.conv_id AND c.call_id = d.call_id LEFT JOIN r a ON a.conv_id = c.conv_id AND a.call_id = c.call_id AND a.n = 1 JOIN e ON e.conv_id = c.conv_id AND e.call_id = c.call_id
UNION ALL SELECT r.conv_id, r.turn, r.role, r.call_id, CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN n > 1 THEN 'duplicate' WHEN r.turn < c.turn THEN 'early' ELSE 'linked' END, COALESCE(depth, -1), 0
  FROM r LEFT JOIN c ON r.conv_id = c.conv_id AND r.call_id = c.call_id LEFT JOIN d ON r.conv_id = d.conv_id AND r.call_id = d.call_id
"""
)
