"""Chat formatting: tool calls linked to their results, checked, ordered and written as canonical JSON.

A message's text may be JSON. An assistant's ``{"tool_calls": [{"id", "name", "arguments"}]}`` makes calls; a
``{"tool_call_id", "content"}`` of role tool makes a result. Calls and results are hash-joined by conversation and
identifier. A call depends on the calls whose results its arguments name as ``"$ref:<id>"``; its level is 0 without
dependencies, else one more than the highest level below it, found by rounds of joins over the call rows alone, as many as
it takes.
Arguments are validated against a table of schemas (name, argument, type, required). JSON is parsed as a variant, whose
objects keep their keys sorted, so what it is written back as is canonical.

Each message stays a row of its own, so a conversation that holds a third of all rows is never gathered.

Defined cases: a text that is not such JSON, null or empty is plain content, as is a message with an empty list of calls;
a ``content`` beside calls, unless null, is a message row of its own; a call without result, or a result without
call, has ``linked`` false; of calls that repeat an identifier in a conversation the first turn counts for links and
levels, later ones are unlinked duplicates; calls in a cycle have level -1; a call of a name without schema is
``valid`` null; arguments that are no object are not valid, nor is an argument of another JSON type than its schema's
(null too), of an unknown name, or a required one that is absent; repeated rows are written each on its own; null ids and
turns join nothing; a very long text is parsed and written whole; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCHEMA_COLUMNS = "name string, argument string, type string, required boolean"
_FAR = 1 << 40
_CALLS = "array<struct<id:string,name:string,arguments:variant>>"


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with the variant of JSON texts, the calls they make, the content beside calls and the identifier they answer."""
    is_json = F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool")
    v = messages.select("conv_id", "turn", "role", "text", F.when(is_json, F.try_parse_json("text")).alias("v"))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", _CALLS))
    answer = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    v = v.withColumns({"calls": calls, "answers": answer})
    # an empty list makes no call, so that its message is a plain one
    v = v.withColumn("calls", F.when(F.size("calls") > 0, F.col("calls")))
    said = F.to_json(F.try_variant_get("v", "$.content", "variant"))
    return v.withColumn("said", F.when(F.col("calls").isNotNull() & (said != "null"), said))


def call_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, id, name, arguments (canonical text), needs (identifiers that the arguments refer to)."""
    one = rows.filter("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("place", "c"))
    one = one.select("conv_id", "turn", "place", "c.id", "c.name", F.to_json("c.arguments").alias("arguments"))
    return one.withColumn("needs", F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'"\$ref:([^"\\]+)"'), F.lit(1))))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level of each first call of an identifier; calls in or above a cycle get -1.

    A call's level is at least ``level``, and for each of its edges ``steps`` more than that of ``need``; a call without edges
    is settled. Every round takes in the edges to settled calls, and leads edges to a call of one edge on to where that one
    leads, so that chains double their reach. Without a cycle each round settles some call, so one that settles none is the last.
    """
    key = ["conv_id", "id"]
    first = calls.filter("conv_id is not null and id is not null").groupBy(*key).agg(F.min(F.struct("turn", "place", "needs")).alias("c"))
    first = cut(first.select(*key, "c.needs"))
    # what refers to an unknown identifier does not wait for it
    edges = first.select(*key, F.explode("needs").alias("need")).join(first.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"])
    edges = cut(edges.select(*key, "need", F.lit(1).cast("long").alias("steps")))
    nodes, settled = first.select(*key, F.lit(0).cast("long").alias("level")), -1
    while not edges.isEmpty():
        ways = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("need", "steps")).alias("next"))
        nodes = cut(nodes.join(ways, key, "left").select(*key, "level", "n", "next"))
        before, settled = settled, nodes.filter("n is null").count()
        if settled == before:
            nodes = nodes.withColumn("level", F.when(F.col("n").isNull(), F.col("level")).otherwise(F.lit(-1)))
            break
        below = nodes.select("conv_id", F.col("id").alias("need"), F.col("level").alias("below"), "n", "next")
        moved = cut(edges.join(below, ["conv_id", "need"]))
        # only in and above cycles, which end at -1, sums come near the bound
        up = moved.filter("n is null or n = 1").groupBy(*key).agg(F.max(F.least(F.col("below") + F.col("steps"), F.lit(_FAR))).alias("up"))
        nodes = nodes.select(*key, "level").join(up, key, "left").select(*key, F.greatest("level", "up").alias("level"))
        steps = F.when(F.col("n") == 1, F.least(F.col("steps") + F.col("next.steps"), F.lit(_FAR))).otherwise(F.col("steps"))
        led = moved.filter("n is not null").select(*key, F.when(F.col("n") == 1, F.col("next.need")).otherwise(F.col("need")).alias("need"), steps.alias("steps"))
        edges = cut(led.groupBy(*key, "need").agg(F.max("steps").alias("steps")))
    return nodes.select(*key, F.col("level").cast("int"))


def _has_type(value: Column, wanted: Column) -> Column:
    """Whether a variant is of a JSON type; an integer is also a number, and a whole number like 3.0 an integer."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = F.coalesce(F.try_variant_get(value, "$", "double") % 1 == 0, F.lit(False))
    return (
        F.when(wanted == "integer", number & whole)
        .when(wanted == "number", number)
        .when(wanted == "boolean", kind == "BOOLEAN")
        .when(wanted == "string", kind == "STRING")
        .when(wanted == "array", kind.startswith("ARRAY"))
        .when(wanted == "object", kind.startswith("OBJECT"))
        .when(wanted == "null", kind == "VOID")
        .otherwise(F.lit(True))
    )


def validity(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, place, valid; ``schemas`` has the columns of SCHEMA_COLUMNS."""
    known = schemas.groupBy("name").agg(F.collect_list(F.struct("argument", "type", "required")).alias("wanted"))
    read = calls.join(known, "name", "left").withColumn("given", F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>"))

    def right(x: Column) -> Column:
        there = F.map_contains_key("given", x["argument"])
        return F.when(~there, ~x["required"]).otherwise(_has_type(F.element_at("given", x["argument"]), x["type"]))

    known_keys = F.forall(F.map_keys("given"), lambda k: F.exists("wanted", lambda x: x["argument"] == k))
    ok = F.when(F.col("wanted").isNull(), F.lit(None).cast("boolean")).when(F.col("given").isNull(), F.lit(False)).otherwise(F.forall("wanted", right) & known_keys)
    return read.select("conv_id", "turn", "place", ok.alias("valid"))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each plain message, content beside calls, call and result: conv_id, turn, place, role, kind, call_id, level, linked, valid,
    json. Ordering by (conv_id, level, turn, place) puts calls after those that they depend on."""
    rows = parsed(messages)
    calls = cut(call_rows(rows))
    results = rows.filter("answers is not null").select("conv_id", "turn", F.col("answers").alias("id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"))
    answered = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("r"))
    owner = calls.filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place")).alias("first"))
    linked = calls.join(answered, ["conv_id", "id"], "left").join(owner, ["conv_id", "id"], "left").join(levels(calls), ["conv_id", "id"], "left")
    linked = linked.join(validity(calls, schemas).dropDuplicates(["conv_id", "turn", "place"]), ["conv_id", "turn", "place"], "left")
    is_first = F.coalesce((F.col("first.turn") == F.col("turn")) & (F.col("first.place") == F.col("place")), F.lit(False))
    hit = is_first & F.coalesce(F.col("r.turn") > F.col("turn"), F.lit(False))
    call_json = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("id"), F.col("name"), F.when(hit, F.try_parse_json("r.content")).alias("result"), F.lit("assistant").alias("role"), F.col("turn")))
    call_out = linked.select("conv_id", "turn", "place", F.lit("assistant").alias("role"), F.lit("call").alias("kind"), F.col("id").alias("call_id"), F.when(is_first, F.col("level")).alias("level"), hit.alias("linked"), "valid", call_json.alias("json"))
    result_json = F.to_json(F.struct(F.try_parse_json("content").alias("content"), F.lit("tool").alias("role"), F.col("id").alias("tool_call_id"), F.col("turn")))
    result_out = results.join(owner, ["conv_id", "id"], "left").select("conv_id", "turn", F.lit(0).alias("place"), F.lit("tool").alias("role"), F.lit("result").alias("kind"), F.col("id").alias("call_id"), F.lit(None).cast("int").alias("level"), F.coalesce(F.col("first.turn") < F.col("turn"), F.lit(False)).alias("linked"), F.lit(None).cast("boolean").alias("valid"), result_json.alias("json"))
    plain_json = F.to_json(F.struct(F.col("text").alias("content"), F.col("role"), F.col("turn")))
    plain = rows.filter("calls is null and answers is null").select("conv_id", "turn", F.lit(0).alias("place"), "role", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid"), plain_json.alias("json"))
    said_json = F.to_json(F.struct(F.try_parse_json("said").alias("content"), F.col("role"), F.col("turn")))
    beside = rows.filter("said is not null").select("conv_id", "turn", F.lit(0).alias("place"), "role", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid"), said_json.alias("json"))
    return plain.unionByName(beside).unionByName(call_out).unionByName(result_out)
