"""Chat formatting with linked tool calls, on the JVM alone.

Messages have a conversation, a turn, a role and a text. An assistant's text may be a JSON object with ``tool_calls``, a
list of objects with ``id``, ``name`` and ``arguments`` (an object, or its JSON text); a tool's text may be a JSON object
with ``tool_call_id`` and ``content``. All other texts are plain messages.

Calls and results are joined by conversation and identifier. A string argument ``$id`` refers to the result of another
call. Calls keep the order of their turns unless one refers to a later one: from turn order, each call's place is raised
above those it refers to until all are. Arguments are checked against schemas (missing, unknown, wrong kind). Every row
is written as canonical JSON: keys sorted, no blanks, no nulls among a call's own fields.

One row per message or call, ordered within its conversation by (place, turn, position). A place is a structure of a turn
and a step, the call's own or one step behind the last call it refers to, so turns and calls may be any number. Of calls that share an
identifier the first stands and the others are marked, as are calls without one; of results that share one the first is
linked and the others stay messages, as do results that no call asked for. References to unknown calls, to itself or in
circles are errors; calls in a circle, or behind one, have a null place. Null conversations are one of their own, null
roles are empty, null texts give null content; rows equal in all columns count once as a call and as often as they come
as a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.session import settle


def _place(turn: Column, step: Column) -> Column:
    """A place in a conversation; null turns come first."""
    return F.struct(turn.alias("turn"), step.cast("long").alias("step"))


def parse(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages with ``calls`` (array of JSON values) or ``result_of`` and ``content``."""
    rows = messages.select(
        messages[conversation].alias("conv"),
        F.coalesce(messages[conversation].cast("string"), F.lit("null")).alias("k"),
        messages[turn].cast("long").alias("turn"),
        F.coalesce(messages[role], F.lit("")).alias("role"),
        messages[text].alias("text"),
    )
    body = F.when(F.ltrim("text", F.lit(" \t\r\n")).startswith("{") & F.col("role").isin("assistant", "tool"), F.try_parse_json("text"))
    marked = rows.withColumn("body", body)
    return marked.select(
        *rows.columns,
        F.when(F.col("role") == "assistant", F.try_variant_get("body", "$.tool_calls", "array<variant>")).alias("calls"),
        F.when(F.col("role") == "tool", F.try_variant_get("body", "$.tool_call_id", "string")).alias("result_of"),
        F.when(F.col("role") == "tool", F.try_variant_get("body", "$.content", "variant")).alias("content"),
    )


def calls_of(parsed: DataFrame) -> DataFrame:
    """One row per call: id, name, arguments (variant), args_json, and the ids it refers to."""
    one = parsed.select("conv", "k", "turn", F.posexplode("calls").alias("position", "c"))
    given = F.try_variant_get("c", "$.arguments", "variant")
    as_text = F.try_variant_get("c", "$.arguments", "string")
    read = one.select(
        "conv",
        "k",
        "turn",
        "position",
        F.try_variant_get("c", "$.id", "string").alias("id"),
        F.coalesce(F.try_variant_get("c", "$.name", "string"), F.lit("")).alias("name"),
        F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(as_text)).otherwise(given).alias("arguments"),
    )
    json = F.to_json(F.col("arguments"))
    needs = F.array_distinct(F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(r'"\$([\w.-]+)"'), F.lit(1)))
    return read.withColumns({"args_json": json, "needs": needs})


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with ``errors`` about their arguments; ``schemas`` has name, argument, kind and required."""
    # Kinds are those of JSON schemas; a whole number also counts as a number.
    wanted = schemas.groupBy(F.col("name").alias("tool")).agg(
        F.collect_set(F.struct("argument", "kind", "required")).alias("schema")
    )
    given = F.expr("try_cast(arguments AS map<string, variant>)")
    joined = calls.withColumn("given", given).join(wanted, F.col("name") == F.col("tool"), "left")
    names = F.map_keys("given")
    missing = F.transform(
        F.filter("schema", lambda s: s["required"] & ~F.coalesce(F.array_contains(names, s["argument"]), F.lit(False))),
        lambda s: F.concat(F.lit("missing:"), s["argument"]),
    )
    unknown = F.transform(
        F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.transform("schema", lambda s: s["argument"])),
        lambda n: F.concat(F.lit("unknown:"), n),
    )

    def wrong(s: Column) -> Column:
        kind = F.regexp_extract(F.schema_of_variant(F.element_at("given", s["argument"])), "^[A-Z]+", 0)
        whole = kind == "BIGINT"
        fits = (
            F.when(s["kind"] == "string", kind == "STRING")
            .when(s["kind"] == "integer", whole)
            .when(s["kind"] == "number", whole | kind.isin("DECIMAL", "DOUBLE", "FLOAT"))
            .when(s["kind"] == "boolean", kind == "BOOLEAN")
            .when(s["kind"] == "object", kind == "OBJECT")
            .when(s["kind"] == "array", kind == "ARRAY")
            .otherwise(F.lit(True))
        )
        return F.coalesce(F.array_contains(names, s["argument"]), F.lit(False)) & ~fits

    kinds = F.transform(F.filter("schema", wrong), lambda s: F.concat(F.lit("kind:"), s["argument"]))
    errors = (
        F.when(F.col("schema").isNull(), F.array(F.lit("no_schema")))
        .when(F.col("given").isNull(), F.array(F.lit("no_object")))
        .otherwise(F.array_sort(F.concat(missing, unknown, kinds)))
    )
    return joined.select(*calls.columns, errors.alias("errors"))


def places(calls: DataFrame) -> DataFrame:
    """(k, id, place, unresolved): an order in which every call stands behind those it refers to.

    ``calls`` has one row per (k, id). Rounds only touch calls that stand before one they refer to.
    """
    start = _place(F.col("turn"), F.col("position"))
    now = settle(calls.select("k", "id", "needs", start.alias("place")))
    links = now.select("k", "id", F.explode("needs").alias("need")).where("id <> need")
    edges = settle(links.join(now.select("k", F.col("id").alias("need")), ["k", "need"]).select("k", "id", "need"))
    now = now.select("k", "id", "place", F.lit(0).alias("hops"), F.lit(False).alias("circle"))
    while True:
        known = now.select("k", F.col("id").alias("need"), "place", "hops", "circle")
        behind = edges.join(known, ["k", "need"]).groupBy("k", "id").agg(
            F.max(F.struct("place", "hops")).alias("last"), F.max("circle").alias("lost")
        )
        late = (F.col("place") <= F.col("last.place")) | F.col("lost")
        raised = settle(
            now.where("NOT circle")
            .join(behind, ["k", "id"])
            .where(late)
            .select("k", "id", _place(F.col("last.place.turn"), F.col("last.place.step") + 1).alias("up"), (F.col("last.hops") + 1).alias("far"), "lost")
        )
        if raised.isEmpty():
            return now.select("k", "id", F.when(~F.col("circle"), F.col("place")).alias("place"))
        after = now.join(raised, ["k", "id"], "left").select(
            "k", "id", F.coalesce("up", "place").alias("place"), F.coalesce("far", "hops").alias("hops"), (F.col("circle") | F.coalesce("lost", F.lit(False))).alias("circle")
        )
        # A chain of raises passes each raised call once, unless it runs in a circle.
        moved = after.where("hops > 0").groupBy("k").agg(F.count("*").alias("moved"))
        bounded = after.join(moved, "k", "left")
        now = settle(bounded.select("k", "id", "place", "hops", (F.col("circle") | (F.col("hops") > F.coalesce("moved", F.lit(0)))).alias("circle")))


def format_chat(
    messages: DataFrame, schemas: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conversation, kind, place, turn, position, call_id, name, errors, json): all messages and calls."""
    parsed = settle(parse(messages, conversation, turn, role, text))
    calls = calls_of(parsed)
    first = calls.where("id IS NOT NULL").groupBy("k", "id").agg(F.min_by(F.struct(*[c for c in calls.columns if c not in ("k", "id")]), F.struct("turn", "position")).alias("c"))
    single = settle(first.select("k", "id", "c.*"))
    checked = check_arguments(single, schemas)
    order = places(single)
    asked = single.select("k", "id", F.explode("needs").alias("need"))
    known = single.select("k", F.col("id").alias("need"), F.lit(True).alias("there"))
    bad = F.col("there").isNull() | (F.col("id") == F.col("need"))
    wrong = asked.join(known, ["k", "need"], "left").where(bad).groupBy("k", "id")
    loose = wrong.agg(F.array_sort(F.collect_set(F.concat(F.lit("reference:"), F.col("need")))).alias("loose"))
    results = parsed.where("result_of IS NOT NULL").groupBy("k", F.col("result_of").alias("id"))
    answers = results.agg(F.min(F.struct("turn", F.to_json("content").alias("json"))).alias("answer"))
    joined = checked.join(order, ["k", "id"]).join(loose, ["k", "id"], "left").join(answers, ["k", "id"], "left")
    circle = F.when(F.col("place").isNull(), F.array(F.lit("circle"))).otherwise(F.array().cast("array<string>"))
    errors = F.concat("errors", F.coalesce("loose", F.array().cast("array<string>")), circle)
    fields = F.struct(
        F.col("arguments").alias("arguments"),
        F.when(F.size(errors) > 0, errors).alias("errors"),
        F.col("id").alias("id"),
        F.col("name").alias("name"),
        F.try_parse_json("answer.json").alias("result"),
    )
    linked = joined.select(
        "k", "conv", F.lit("call").alias("kind"), "place", "turn", "position", F.col("id").alias("call_id"), "name", errors.alias("errors"), F.to_json(fields).alias("json")
    )
    # What is not the first call of its identifier.
    spare = calls.join(single.select("k", "id", F.col("turn").alias("t1"), F.col("position").alias("p1")), ["k", "id"], "left").where(
        F.col("p1").isNull() | (F.struct("turn", "position") > F.struct("t1", "p1"))
    )
    mark = F.array(F.when(F.col("id").isNull(), "no_id").otherwise("repeated_id"))
    own = F.struct(F.col("arguments").alias("arguments"), mark.alias("errors"), F.col("id").alias("id"), F.col("name").alias("name"))
    start = _place(F.col("turn"), F.col("position"))
    others = spare.select("k", "conv", F.lit("call").alias("kind"), start.alias("place"), "turn", "position", F.col("id").alias("call_id"), "name", mark.alias("errors"), F.to_json(own).alias("json"))
    # Results that were linked are part of their call; the rest are messages.
    used = joined.where("answer IS NOT NULL").select("k", F.col("id").alias("result_of"), F.col("answer.turn").alias("taken"), F.col("answer.json").alias("taken_json"))
    plain = parsed.where("calls IS NULL").join(used, ["k", "result_of"], "left")
    plain = plain.where(~F.coalesce((F.col("turn") == F.col("taken")) & F.to_json("content").eqNullSafe(F.col("taken_json")), F.lit(False)))
    said = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    spoken = plain.select(
        "k", "conv", F.lit("message").alias("kind"), _place(F.col("turn"), F.lit(0)).alias("place"), "turn", F.lit(0).alias("position"),
        F.col("result_of").alias("call_id"), F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("errors"), said.alias("json"),
    )
    out = linked.unionByName(others).unionByName(spoken)
    return out.select(F.col("conv").alias(conversation), *[c for c in out.columns if c not in ("k", "conv")])
