"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

Only DataFrame and SQL functions are used.  A message is a row (conv_id, turn, role,
text).  The text of an assistant's message may be a JSON object with ``tool_calls``:
objects with id, name, arguments (an object, or one written as a string) and
optionally depends_on (ids of calls whose results it needs).  The text of a tool's
message is a JSON object with tool_call_id and content.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: JSON types and the names of the variant types that fit them.
FITTING = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
    "boolean": ["BOOLEAN"],
    "object": ["OBJECT"],
    "array": ["ARRAY"],
    "null": ["VOID"],
}


def tool_calls(messages: DataFrame) -> DataFrame:
    """Calls in assistants' messages: conv_id, turn, place, id, name, arguments (variant, null if not JSON) and depends_on."""
    body = messages.where("role = 'assistant' and ltrim(text) like '{%'").withColumn("body", F.expr("try_parse_json(text)"))
    calls = body.select("conv_id", "turn", F.posexplode(F.expr("try_variant_get(body, '$.tool_calls', 'array<variant>')")).alias("place", "call"))
    return calls.select(
        "conv_id",
        "turn",
        "place",
        F.expr("try_variant_get(call, '$.id', 'string')").alias("id"),
        F.expr("try_variant_get(call, '$.name', 'string')").alias("name"),
        F.expr("try_parse_json(try_variant_get(call, '$.arguments', 'string'))").alias("arguments"),
        F.expr("try_variant_get(call, '$.depends_on', 'array<string>')").alias("depends_on"),
    )


def tool_results(messages: DataFrame) -> DataFrame:
    """Results in tools' messages: conv_id, turn and id of the call; of several for one call the earliest turn."""
    rows = messages.where("role = 'tool'").select("conv_id", "turn", F.expr("try_variant_get(try_parse_json(text), '$.tool_call_id', 'string')").alias("id"))
    return rows.where("id is not null and conv_id is not null").groupBy("conv_id", "id").agg(F.min("turn").alias("result_turn"))


def _rules(schemas: DataFrame) -> tuple[DataFrame, int]:
    """What a schema asks for at each path (tool, path, types, choices, required, closed), and how deep it goes.

    Paths name an object's member by .key and an array's items by [].  A tool's schemas are
    read level by level, as many rounds as they are deep.
    """
    level = schemas.groupBy("tool").agg(F.first("parameters", ignorenulls=True).alias("p")).select("tool", F.lit("").alias("path"), F.expr("try_parse_json(p)").alias("s"))
    found, depth = None, 0
    while True:
        one = F.expr("case when schema_of_variant(variant_get(s, '$.type', 'variant')) = 'STRING' then array(try_variant_get(s, '$.type', 'string')) end")
        rules = level.select(
            "tool",
            "path",
            F.coalesce(one, F.expr("try_variant_get(s, '$.type', 'array<string>')")).alias("types"),
            F.expr("transform(try_variant_get(s, '$.enum', 'array<variant>'), e -> to_json(e))").alias("choices"),
            F.coalesce(F.expr("try_variant_get(s, '$.required', 'array<string>')"), F.array().cast("array<string>")).alias("required"),
            F.coalesce(F.expr("not try_variant_get(s, '$.additionalProperties', 'boolean')"), F.col("path") == "").alias("closed"),
        )
        found = rules if found is None else found.unionByName(rules)
        members = level.select("tool", "path", F.explode(F.expr("try_variant_get(s, '$.properties', 'map<string,variant>')")).alias("key", "s"))
        items = level.select("tool", F.concat("path", F.lit("[]")).alias("path"), F.expr("variant_get(s, '$.items', 'variant')").alias("s")).where("s is not null")
        level = members.select("tool", F.concat_ws(".", "path", "key").alias("path"), "s").unionByName(items)
        depth += 1
        if level.isEmpty():
            return cut(found, "rules"), depth


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds valid: the tool is known and its arguments fit its schema.

    schemas: (tool, parameters), parameters being a JSON schema.  Read are type (one or
    several), enum, required, properties, items and additionalProperties, at every depth;
    arguments that the schema doesn't name are wrong at the top, and below it only
    where additionalProperties is false.  Every value meets the rule of its path by an
    equal-key join, level by level.
    """
    rules, depth = _rules(schemas)
    known = F.broadcast(rules)  # bounded: the tools' schemas
    at = ["conv_id", "turn", "place"]
    level = calls.select(*at, F.col("name").alias("tool"), F.lit("").alias("path"), F.col("arguments").alias("v"))
    kind = F.regexp_extract(F.expr("schema_of_variant(v)"), "^[A-Z]+", 0)
    wrong = None
    for _ in range(depth):
        held = level.join(known, ["tool", "path"]).withColumns({"own": kind, "members": F.expr("try_variant_get(v, '$', 'map<string,variant>')")})
        fits = F.col("types").isNull()
        for name, fitting in FITTING.items():
            fits = fits | (F.array_contains("types", name) & F.col("own").isin(fitting))
        whole = F.size(F.array_except("required", F.coalesce(F.map_keys("members"), F.array().cast("array<string>")))) == 0
        chosen = F.col("choices").isNull() | F.array_contains("choices", F.to_json("v"))
        good = fits & chosen & ((F.col("own") != "OBJECT") | whole) & F.col("v").isNotNull()
        bad = held.where(~F.coalesce(good, F.lit(False))).select(at)
        members = held.select(*at, "tool", "closed", "path", F.explode("members").alias("key", "v"))
        members = members.select(*at, "tool", "closed", F.concat_ws(".", "path", "key").alias("path"), "v")
        strange = members.where("closed").join(known.select("tool", "path"), ["tool", "path"], "left_anti").select(at)
        items = held.where("own = 'ARRAY'").select(*at, "tool", F.concat("path", F.lit("[]")).alias("path"), F.explode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("v"))
        here = bad.unionByName(strange)
        wrong = here if wrong is None else wrong.unionByName(here)
        level = members.drop("closed").unionByName(items)
    wrong = wrong.distinct().withColumn("wrong", F.lit(True))
    tools = F.broadcast(rules.where("path = ''").select(F.col("tool").alias("name"), F.lit(True).alias("has_tool")))
    held = calls.join(tools, "name", "left").join(wrong, at, "left")
    is_object = F.coalesce(F.regexp_like(F.expr("schema_of_variant(arguments)"), F.lit("^OBJECT")), F.lit(False))
    valid = F.coalesce("has_tool", F.lit(False)) & is_object & ~F.coalesce("wrong", F.lit(False))
    return held.withColumn("valid", valid).drop("has_tool", "wrong")


def levels(calls: DataFrame) -> DataFrame:
    """The topological level of each call (conv_id, id): 0 without needs, else one more than the highest it needs.

    Calls on a cycle, or that need one, have no row.  Needs of calls that aren't there
    are left out.  Each round settles one level and is written to the shared folder.
    """
    named = calls.where("id is not null and conv_id is not null")
    nodes = named.groupBy("conv_id", "id").agg(F.flatten(F.collect_list(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("needs"))
    needs = nodes.select("conv_id", "id", F.explode(F.array_distinct("needs")).alias("need"))
    needs = needs.join(nodes.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi")
    open_ = cut(needs, "needs")
    done = cut(nodes.select("conv_id", "id").join(open_, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    all_done, level = done, 0
    while not open_.isEmpty() and not done.isEmpty():
        level += 1
        left = cut(open_.join(done.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_anti"), "needs")
        done = open_.select("conv_id", "id").distinct().join(left, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(level))
        done = cut(done, "levels")
        all_done, open_ = all_done.unionByName(done), left
    return all_done


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each message, with its calls linked, ordered and validated, and canonical JSON.

    messages needs conv_id, turn, role and text; other columns are ignored.  Returns
    conv_id, turn, role, n_calls, n_linked (calls with a result), n_valid, level
    (highest topological level of its calls, 0 without; null if one is on a cycle) and
    message: canonical JSON of content and role and, for calls, tool_calls with their
    arguments, id, level, linked, name and valid, a call after those it needs.

    A null text has a null content, and a null anywhere is written as one; empty and very long texts are kept whole.  Calls
    without an id link with nothing.  Where a conversation uses an id twice both
    calls link with its result.  Repeated rows give repeated rows.  No conversation is
    brought together in one place.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = tool_calls(messages.distinct())
    linked = calls.hint("shuffle_hash").join(tool_results(messages), ["conv_id", "id"], "left")
    linked = linked.withColumn("linked", F.col("result_turn").isNotNull())
    judged = validated(linked, schemas).join(levels(calls), ["conv_id", "id"], "left")
    # in the order of need: calls on a cycle come last, of one level the earlier in the message
    told = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("order"), "place", F.struct(F.expr("to_json(arguments)").alias("arguments"), "id", "level", "linked", "name", "valid").alias("call"))
    own = judged.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_calls"),
        F.count_if("linked").alias("n_linked"),
        F.count_if("valid").alias("n_valid"),
        F.when(F.count_if(F.col("level").isNull() & F.col("id").isNotNull()) == 0, F.coalesce(F.max("level"), F.lit(0))).alias("level"),
        F.transform(F.array_sort(F.collect_list(told)), lambda c: c["call"]).alias("calls"),
    )
    own = own.withColumn("has_calls", F.lit(True))
    calling = messages.where("role = 'assistant' and ltrim(text) like '{%'").join(own, ["conv_id", "turn"], "left")
    plain = messages.where("not coalesce(role = 'assistant' and ltrim(text) like '{%', false)")
    for name, kind in (("n_calls", "long"), ("n_linked", "long"), ("n_valid", "long"), ("level", "int"), ("has_calls", "boolean")):
        plain = plain.withColumn(name, F.lit(None).cast(kind))
    plain = plain.withColumn("calls", F.lit(None).cast(own.schema["calls"].dataType))
    rows = calling.unionByName(plain)
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    keep = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), keep)
    message = F.when(F.col("calls").isNull(), plain).otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role", F.col("calls").alias("tool_calls")), keep))
    level = F.when(F.col("has_calls"), F.col("level")).otherwise(F.lit(0))
    return rows.select("conv_id", "turn", "role", count("n_calls"), count("n_linked"), count("n_valid"), level.cast("int").alias("level"), message.alias("message"))
