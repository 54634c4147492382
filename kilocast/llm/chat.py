"""Chat formatting with tool calls: linked, ordered, validated and written as canonical JSON.

Calls and results are joined by call id. A call may refer to other calls; it
must come after them. Messages keep their given order unless a reference
points forward: then the referring call moves behind. Each call has a level,
zero at first (a message that brings a result refers to its call); a reference to a later message raises the level by one, one to
an earlier message keeps it, and levels follow the references until nothing
changes. Sorting by level, turn and place is then a topological order. A level
above the number of forward references of its conversation means a cycle: the
calls on it and behind it are marked and keep their given place.

Arguments are JSON objects checked against the tool's schema: unknown tool,
unparsable arguments, missing, unknown or mistyped parameters. Canonical JSON
has no spaces and its keys in order, at every depth.

Everything is DataFrame functions; one conversation may hold any share of the
rows: positions are counted in blocks of ``BLOCK`` turns.

Defined results: rows with null conversation or turn are ordered with the
other nulls, first; a null or empty text stays null or empty; a null call id
links with nothing; of several results of one call the one with the smallest
turn and content is taken, of several calls of one id (repeated rows) each is
linked to the same result; references to unknown ids or to the call itself
are reported as errors and do not order. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilocast.llm.common import read, stored

BLOCK = 256
MAX_ROUNDS = 10_000


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(row, errors): of each call (row, tool, arguments) the sorted list of what is wrong with its arguments.

    ``schemas``: tool, param, type (string, integer, number, boolean, array, object), required.
    """
    spark = calls.sparkSession
    parsed = calls.select("row", "tool", F.try_parse_json("arguments").alias("args"))
    shape = F.schema_of_variant("args")
    parsed = parsed.withColumn("is_object", F.coalesce(shape.startswith("OBJECT"), F.lit(False)))
    entries = parsed.where("is_object").lateralJoin(spark.tvf.variant_explode(F.col("args").outer())).select(
        "row", F.col("key").alias("param"), F.schema_of_variant("value").alias("kind")
    )
    known = schemas.select("tool").distinct().withColumn("known", F.lit(True))
    expected = parsed.where("is_object").select("row", "tool").join(schemas, "tool").select("row", "param", "type", "required")
    tools = parsed.select("row", "tool", "is_object").join(known, "tool", "left")
    whole = tools.select(
        "row",
        F.when(F.col("known").isNull(), F.lit("unknown tool")).when(~F.col("is_object"), F.lit("arguments are not an object")).alias("error"),
    )
    kind = F.col("kind")
    right = (
        F.when(F.col("type") == "string", kind == "STRING")
        .when(F.col("type") == "integer", kind == "BIGINT")
        .when(F.col("type") == "number", (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"))
        .when(F.col("type") == "boolean", kind == "BOOLEAN")
        .when(F.col("type") == "array", kind.startswith("ARRAY"))
        .otherwise(kind.startswith("OBJECT"))
    )
    named = (
        entries.join(expected, ["row", "param"], "full")
        .join(tools.where("known is not null").select("row"), "row", "left_semi")
        .select(
            "row",
            F.when(kind.isNull() & F.col("required"), F.concat(F.lit("missing "), "param"))
            .when(kind.isNotNull() & F.col("type").isNull(), F.concat(F.lit("unknown "), "param"))
            .when(kind.isNotNull() & ~right, F.concat(F.lit("wrong type of "), "param"))
            .alias("error"),
        )
    )
    return whole.union(named).groupBy("row").agg(F.sort_array(F.collect_set("error")).alias("errors"))


def levels(edges: DataFrame) -> DataFrame:
    """(row, level, cyclic) of the calls that forward references reach.

    ``edges``: row, needs, conv_id, forward (the needed call stands later).
    """
    forward = edges.where("forward").groupBy("conv_id").agg(F.count("*").alias("most"))
    edges = stored(edges.join(forward, "conv_id").select("row", "needs", F.col("forward").cast("long").alias("rise"), "most"))
    start = edges.where("rise = 1").select("row", F.lit(1).cast("long").alias("level"), "most").distinct()
    reached = frontier = stored(start)
    for _ in range(MAX_ROUNDS):
        raised = (
            frontier.where("level <= most + 1")
            .select(F.col("row").alias("needs"), "level")
            .join(edges, "needs")
            .groupBy("row")
            .agg(F.max(F.col("level") + F.col("rise")).alias("new"), F.max("most").alias("most"))
        )
        frontier = stored(
            raised.join(reached.select("row", "level"), "row", "left")
            .where("level is null or new > level")
            .select("row", F.col("new").alias("level"), "most")
        )
        if frontier.isEmpty():
            break
        reached = stored(reached.union(frontier).groupBy("row").agg(F.max("level").alias("level"), F.max("most").alias("most")))
    else:
        raise RuntimeError(f"a chain of calls is longer than {MAX_ROUNDS} references; raise MAX_ROUNDS")
    return reached.select("row", "level", (F.col("level") > F.col("most")).alias("cyclic"))


def positions(rows: DataFrame, group: str, order: list[str], block: Column) -> DataFrame:
    """Place of each row in its group, from 0; ``block`` must not fall along the order.

    Rows are numbered inside blocks, and blocks by sums of their sizes, so that a large group is spread over tasks.
    """
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(group).alias("_group"), F.col("_block").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    counted = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        counted.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_at")))
        .withColumn("step", F.col("_before") + F.col("_inside"))
        .drop("_block", "_group", "_at", "_before", "_inside")
    )


def canonical(parts: dict[str, Column]) -> Column:
    """A JSON object of the given values, keys in order; values are JSON texts, null ones are left out."""
    fields = [F.concat(F.lit(f'"{name}":'), parts[name]) for name in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def json_text(value: Column) -> Column:
    """A string as a JSON text."""
    inner = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), inner.substr(F.lit(6), F.length(inner) - 6))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One canonical JSON line for each message, in a topological order of its conversation.

    ``messages``: conv_id, turn, role, text. ``calls``: conv_id, turn, call_id,
    tool, arguments (JSON), needs (ids). ``results``: call_id, turn, content.
    Returns conv_id, step, turn, role, call_id, tool, linked, errors, json.
    """
    rows = stored(
        messages.select("conv_id", "turn", "role", "text")
        .join(calls.select("conv_id", "turn", "call_id", "tool", "arguments", "needs"), ["conv_id", "turn"], "left")
        .withColumn("row", F.xxhash64("conv_id", "turn", "role", "text", "call_id", "tool", "arguments"))
    )
    called = rows.where("tool is not null or call_id is not null")
    distinct = called.dropDuplicates(["row"])
    asked = distinct.select("row", "conv_id", "turn", "call_id", F.explode("needs").alias("need"))
    targets = distinct.where("call_id is not null").select(
        F.col("call_id").alias("need"), F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.col("row").alias("needs")
    )
    found = stored(
        asked.join(targets, (asked.need == targets.need) & (asked.conv_id == targets.of) & (asked.row != targets.needs), "left").select(
            "row", "conv_id", asked.need, "needs", (F.col("at") >= F.col("turn")).alias("forward")
        )
    )
    # The message that brings a result stands behind its call, too.
    brought = results.where("call_id is not null").select(F.col("call_id").alias("need"), F.col("turn").alias("at")).distinct()
    behind = (
        targets.select("need", F.col("of").alias("conv_id"), F.col("at").alias("called"), "needs")
        .join(brought, "need")
        .withColumnRenamed("at", "turn")
        .join(rows.select("conv_id", "turn", "row"), ["conv_id", "turn"])
        .where("row <> needs")
        .select("row", "needs", "conv_id", (F.col("called") >= F.col("turn")).alias("forward"))
        .distinct()
    )
    placed = levels(found.where("needs is not null").select("row", "needs", "conv_id", "forward").union(behind))
    lost = found.where("needs is null").select("row", F.concat(F.lit("unknown reference "), "need").alias("error"))
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    wrong = (
        validate(distinct, schemas)
        .select("row", F.explode("errors").alias("error"))
        .union(lost)
        .union(placed.where("cyclic").select("row", F.lit("reference cycle")))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("error")).alias("errors"))
    )
    full = (
        rows.join(placed, "row", "left")
        .join(wrong, "row", "left")
        # Messages without a call have a key of their own, so that they do not meet in one task.
        .withColumn("_key", F.coalesce("call_id", F.concat(F.lit("\u0000"), F.col("row").cast("string"))))
        .join(answers.withColumnRenamed("call_id", "_key"), "_key", "left")
        .drop("_key")
        .withColumn("level", F.when(F.col("cyclic"), F.lit(0)).otherwise(F.coalesce("level", F.lit(0))))
    )
    # A block holds turns of one level; levels come first in the order.
    block = F.struct(F.col("level").alias("l"), F.floor(F.col("turn") / BLOCK).alias("b"))
    stepped = positions(full, "conv_id", ["level", "turn", "row"], block)
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    call = canonical(
        {
            "arguments": F.coalesce(F.to_json(F.try_parse_json("arguments")), json_text(F.col("arguments"))),
            "id": json_text(F.col("call_id")),
            "name": json_text(F.col("tool")),
            "result": json_text(F.col("answer.content")),
            "valid": F.when(F.size(errors) == 0, "true").otherwise("false"),
        }
    )
    is_call = F.col("tool").isNotNull() | F.col("call_id").isNotNull()
    line = canonical(
        {"call": F.when(is_call, call), "content": json_text(F.col("text")), "role": json_text(F.col("role"))}
    )
    return stepped.select(
        "conv_id",
        "step",
        "turn",
        "role",
        "call_id",
        "tool",
        (is_call & F.col("answer").isNotNull()).alias("linked"),
        F.when(is_call, F.array_join(errors, "; ")).alias("errors"),
        line.alias("json"),
    )


#: The tools of the registered query.
SCHEMAS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("search", "after", "string", False),
    ("compute", "query", "string", True),
    ("compute", "limit", "number", False),
    ("compute", "precise", "boolean", True),
]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn of ``conversations`` as a tool call, answered by the turn after it.

    The call names search, compute or browse by its turn; it needs the call two
    turns before, or, at turns 8k + 1, the one two turns after.
    """
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def named(turn: Column) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)

    turn = F.col("turn")
    other = F.when(turn % 8 == 1, turn + 2).when(turn % 8 != 3, turn - 2)
    words = F.size(F.split("text", " "))
    calls = messages.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        named(turn).alias("call_id"),
        F.when(turn % 5 == 4, "browse").when(turn % 3 == 0, "compute").otherwise("search").alias("tool"),
        F.to_json(
            F.struct(F.substring_index("text", " ", 4).alias("query"), words.alias("limit"), named(other).alias("after"))
        ).alias("arguments"),
        F.when(other >= 0, F.array(named(other))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = messages.where("role = 'user'").select(named(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean")
    return format_chats(messages, calls, results, schemas)
