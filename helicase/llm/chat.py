"""Linking of tool calls with their results.

Calls and results meet in a hash join on (conversation, identifier). Calls are put in
topological order by levels: a call stands one level above the highest of its
dependencies. Arguments are checked against the schema of their tool and
every exchange is written as canonical JSON (sorted keys, no blanks).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helicase.llm.common import staged

#: Number of parameters of all tools together; their table is sent to all executors.
MAX_PARAMETERS = 100_000

CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
#: tool, parameter, JSON type (string, integer, number, boolean, object, array), whether it must be there, smallest and
#: largest number (of a string: of its length).
TOOLS = "tool string, parameter string, type string, required boolean, low double, high double"


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand in the texts of messages (conv_id, turn, role, text).

    A call is `<tool_call>{"id":..,"name":..,"arguments":{..},"after":[..]}</tool_call>` in a message of the assistant, a
    result `<tool_result id="..">..</tool_result>` in a message of the tool. Null texts hold none; broken JSON gives a
    call without a name, identified by its place.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1)))
    found = m.filter((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))).select("conv_id", "turn", block.alias("b"))
    get = lambda k: F.get_json_object("b", f"$.{k}")
    calls = found.select(
        "conv_id", F.coalesce(get("id"), F.concat_ws("-", F.lit("unnamed"), "turn", F.md5("b"))).alias("call_id"), "turn",
        get("name").alias("name"), F.coalesce(get("arguments"), F.lit("{}")).alias("arguments"),
        F.coalesce(F.from_json(get("after"), "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    pattern = r'(?s)<tool_result id="([^"]*)">(.*?)</tool_result>'
    whole = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    results = (
        m.filter((F.col("role") == "tool") & F.contains("text", F.lit("<tool_result")))
        .select("conv_id", "turn", whole.alias("r"))
        .select("conv_id", F.regexp_extract("r", pattern, 1).alias("call_id"), "turn", F.regexp_extract("r", pattern, 2).alias("content"))
    )
    return calls, results


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls that no cycle holds back; level 0 has no dependency among the calls.

    Chains of calls with one dependency each are shortened by doubling, so that a conversation of n turns takes log n
    rounds; rounds of one level each are left for calls with several dependencies.
    """
    key = ["conv_id", "call_id"]
    keys = calls.select(*key)
    known = keys.withColumnRenamed("call_id", "needs")
    edges = calls.select(*key, F.explode(F.array_distinct("after")).alias("needs")).join(known, ["conv_id", "needs"])
    edges = staged(edges.withColumn("n", F.count("*").over(Window.partitionBy(*key))), "chat-edges")
    jumps = edges.filter("n = 1").select(*key, F.col("needs").alias("to"), F.lit(1).cast("bigint").alias("far"))
    inner = jumps.select("conv_id", F.col("call_id").alias("to"))  # of chains
    reach, most = 1, jumps.count()
    jumps = staged(jumps, "chat-jumps")
    while reach <= 2 * most:
        nxt = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        step = jumps.join(nxt, ["conv_id", "to"], "left")
        jumps = staged(step.select(*key, F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("to2").isNull().alias("ends")), "chat-jumps")
        reach *= 2
        if jumps.filter("not ends").isEmpty():
            break
        jumps = jumps.drop("ends")
    # chains that end at a call with none or several dependencies; the others run into a cycle
    chains = jumps.join(inner, ["conv_id", "to"], "left_anti").select(*key, F.col("to").alias("anchor"), "far")
    done = keys.join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    to_chain = chains.select("conv_id", F.col("call_id").alias("needs"), "anchor", "far")
    several = edges.filter("n > 1").join(to_chain, ["conv_id", "needs"], "left")
    several = several.join(jumps.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("single")), ["conv_id", "needs"], "left")
    # a dependency that runs into a cycle has no anchor and is never met
    several = several.select(*key, F.when(F.col("single"), F.col("anchor")).otherwise(F.col("needs")).alias("anchor"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(None).cast("bigint").alias("level"))
    parts = [staged(done, "chat-levels")]
    several = staged(several, "chat-several")
    while not several.isEmpty():
        fresh = parts[-1].select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("now"))
        several = staged(several.join(fresh, ["conv_id", "anchor"], "left").select(*key, "anchor", "far", F.coalesce("level", F.col("now") + F.col("far")).alias("level")), "chat-several")
        ready = several.groupBy(*key).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0").select(*key, "level")
        ready = staged(ready, "chat-levels")
        if ready.isEmpty():
            break
        parts.append(ready)
        several = staged(several.join(ready.select(*key), key, "left_anti"), "chat-several")
    anchors = functools.reduce(DataFrame.unionByName, parts)
    below = chains.join(anchors.select("conv_id", F.col("call_id").alias("anchor"), "level"), ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return anchors.unionByName(below).select(*key, F.col("level").cast("int").alias("level"))


def _errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) of the calls with errors: sorted texts `kind:parameter`."""
    if tools.count() > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} parameters")
    parsed = calls.select("conv_id", "call_id", "name", F.try_parse_json("arguments").alias("v"))
    parsed.createOrReplaceTempView("__chat_parsed")
    spark = calls.sparkSession
    given = spark.sql("SELECT conv_id, call_id, name, a.key AS parameter, a.value AS value FROM __chat_parsed, LATERAL variant_explode(v) AS a WHERE schema_of_variant(v) LIKE 'OBJECT%'")
    spark.catalog.dropTempView("__chat_parsed")
    kind = F.schema_of_variant("value")
    number = F.try_variant_get("value", "$", "double")
    text = F.try_variant_get("value", "$", "string")
    is_type = {
        "string": kind == "STRING", "integer": kind == "BIGINT", "number": (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"),
        "boolean": kind == "BOOLEAN", "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"),
    }
    right = F.lit(False)
    for name, test in is_type.items():
        right = right | ((F.col("type") == name) & test)
    amount = F.when(F.col("type") == "string", F.length(text).cast("double")).otherwise(number)
    spec = tools.withColumnRenamed("tool", "name")
    seen = given.join(F.broadcast(spec), ["name", "parameter"], "left").select(
        "conv_id", "call_id",
        F.when(F.col("type").isNull(), F.lit("unknown")).when(~right, F.lit("type"))
        .when((amount < F.col("low")) | (amount > F.col("high")), F.lit("range")).alias("kind"), "parameter",
    )
    wanted = parsed.join(F.broadcast(spec.filter("required").select("name", "parameter")), "name").select("conv_id", "call_id", "parameter")
    missing = wanted.join(given.select("conv_id", "call_id", "parameter"), ["conv_id", "call_id", "parameter"], "left_anti").withColumn("kind", F.lit("missing"))
    names = spec.select("name").distinct()
    tool = parsed.join(F.broadcast(names), "name", "left_anti").select("conv_id", "call_id", F.coalesce("name", F.lit("")).alias("parameter"), F.lit("tool").alias("kind"))
    broken = parsed.filter("v is null or schema_of_variant(v) not like 'OBJECT%'").select("conv_id", "call_id", F.lit("arguments").alias("parameter"), F.lit("json").alias("kind"))
    rows = seen.filter("kind is not null").unionByName(missing).unionByName(tool).unionByName(broken)
    return rows.groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set(F.concat_ws(":", "kind", "parameter"))).alias("errors"))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each (conversation, identifier) of `calls` and `results` (schemas CALLS, RESULTS; others are ignored).

    conv_id, call_id, level, status, n_calls, n_results, errors, json. Calls are ordered by level, then turn. Calls that
    repeat an identifier within a conversation, and repeated results, are counted and the one of the lowest turn (then
    the lowest text) is used. status: `orphan` (a result without a call), `cyclic` (held back by a cycle; level null),
    `invalid` (errors isn't empty), `unanswered`, else `ok`. Dependencies on unknown identifiers are ignored. A null
    conversation or identifier links with nothing; those rows are left out. Null arguments count as {}.
    """
    known = "conv_id is not null and call_id is not null"
    body = F.struct("turn", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("{}")).alias("arguments"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    one = calls.filter(known).groupBy("conv_id", "call_id").agg(F.min(body).alias("c"), F.count("*").alias("n_calls")).select("conv_id", "call_id", "c.*", "n_calls")
    one = staged(one, "chat-calls")
    res = results.filter(known).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    res = res.select("conv_id", "call_id", F.col("r.content").alias("content"), "n_results")
    key = ["conv_id", "call_id"]
    all_ = one.join(res, key, "full").join(_levels(one), key, "left").join(_errors(one, tools), key, "left")
    none = F.array().cast("array<string>")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("level").isNull(), "cyclic").when(F.size(F.coalesce("errors", none)) > 0, "invalid")
        .when(F.col("n_results").isNull(), "unanswered").otherwise("ok")
    )
    full = all_.select(
        *key, "turn", "level", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("errors", none).alias("errors"), F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.lit("{}"))).alias("v"), "name", "content",
    )
    doc = F.to_json(
        F.struct(F.col("v").alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"), "status"),
        {"ignoreNullFields": "false"},
    )
    return full.select(*key, "turn", "level", "status", "n_calls", "n_results", F.array_join("errors", ",").alias("errors"), doc.alias("json"))
