"""Tool-call linking for chat transcripts.

Calls and results are two relations keyed by (conv_id, call_id). They are hash-joined,
ordered so that a call comes after the calls whose results it refers to, validated
against argument schemas and serialised as canonical JSON: keys sorted at every depth, no
blanks, numbers and strings kept apart. Arguments are read as variants, so what is checked is
the JSON type that was written, and each tool has its own types.

Order: a reference that points to an earlier call is already satisfied by transcript
order, so such conversations are ordered by turn alone, however long they are. Of
conversations with a forward reference those with at most SMALL calls are ordered in one
pass: their levels (longest chains of references) are relaxed within one row, which SMALL
bounds. Larger ones whose calls have one reference each go by pointer doubling, the others
through rounds of Kahn's algorithm, one frontier a round. Calls on a
cycle, or that wait for one, have level -1. Positions come from counts per (conversation,
block of turns), so a conversation with a third of all rows is spread over many tasks.

Defined cases: a call without a result has status `unanswered`, a result without a call
`orphan` (name null); repeated calls of one id keep the first by (turn, idx, name,
arguments), likewise results; null conv_id or call_id never link and keep their row, and rows
without conv_id have no position; null arguments count as none, arguments that are no JSON
object (or name a key twice) are an error and are kept as a string; a null value is of no type;
references to unknown calls are ignored; texts and arguments of any length are kept whole; rows
equal in (level, turn, idx, call_id) go by their JSON; a table without calls gives an empty
result; columns other than those named, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

BLOCK, SMALL = 64, 64
#: What a value's type must look like; a schema maps an argument to (type, required).
TYPES = {"string": r"\ASTRING\z", "integer": r"\A(BIGINT|DECIMAL\([0-9]+,0\))\z", "number": r"\A(BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))\z", "boolean": r"\ABOOLEAN\z", "array": r"\AARRAY<", "object": r"\AOBJECT<"}
CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,refs:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
Schemas = dict[str, dict[str, tuple[str, bool]]]


def parse_calls(messages: DataFrame) -> DataFrame:
    """Calls in messages(conv_id, turn, role, text): assistant texts that are JSON objects with tool_calls. Arguments: an object, or one written as a string."""
    found = messages.where((F.col("role") == "assistant") & F.col("text").startswith("{")).select("conv_id", "turn", F.posexplode(F.from_json("text", CALLS)["tool_calls"]).alias("idx", "c"))
    written = F.when(F.schema_of_variant("c.arguments") == "STRING", F.try_variant_get("c.arguments", "$", "string")).otherwise(F.to_json("c.arguments"))
    return found.select("conv_id", "turn", "idx", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.when(F.col("c.arguments").isNotNull(), written).alias("arguments"), F.col("c.refs").alias("refs"))


def parse_results(messages: DataFrame) -> DataFrame:
    """Results in messages: texts of role tool that are JSON objects with tool_call_id."""
    found = messages.where(F.col("role") == "tool").select("conv_id", "turn", F.from_json("text", RESULT).alias("r"))
    return found.where(F.col("r.tool_call_id").isNotNull()).select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


def typed(calls: DataFrame) -> DataFrame:
    """calls with whole (arguments as a variant, null if they are no JSON object) and types (argument to type)."""
    value = F.try_parse_json("arguments")
    out = calls.withColumn("whole", F.when(F.schema_of_variant(value).startswith("OBJECT<"), value))
    types = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda _, x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")))
    return out.withColumn("types", F.when(F.col("whole").isNotNull(), types).otherwise(F.create_map().cast("map<string,string>")))


def violations(schemas: Schemas) -> Column:
    """Sorted messages on what in (name, arguments, whole, types) breaks its tool's schema; an empty array where nothing does."""
    types, out = F.col("types"), F.when(F.col("arguments").isNotNull() & F.col("whole").isNull(), F.array(F.lit("arguments are no JSON object")))
    for tool, schema in schemas.items():
        faults = [F.when(~F.map_contains_key(types, a), F.lit(f"missing {a}")) for a, (_, required) in schema.items() if required]
        faults += [F.when(F.map_contains_key(types, a) & ~F.try_element_at(types, F.lit(a)).rlike(TYPES[kind]), F.lit(f"{a} is not {kind}")) for a, (kind, _) in schema.items()]
        known = F.array(*[F.lit(a) for a in schema]) if schema else F.array().cast("array<string>")
        unknown = F.transform(F.array_except(F.map_keys(types), known), lambda k: F.concat(F.lit("unknown "), k))
        out = out.when(F.col("name") == tool, F.sort_array(F.concat(F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>"), unknown)))
    return out.otherwise(F.array(F.lit("unknown tool")))


def quoted(c: Column) -> Column:
    """c as a JSON string, null as null."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").otherwise(F.substring(j, F.lit(6), F.length(j) - 6))


def canonical() -> Column:
    """{"arguments":...,"id":...,"name":...,"result":...}: keys sorted, no blanks."""
    args = F.when(F.col("arguments").isNull(), "{}").when(F.col("whole").isNull(), quoted(F.col("arguments"))).otherwise(F.to_json("whole"))
    return F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"))


def _first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the least by order: a partial aggregate, so repeats collapse before the shuffle."""
    cols = [c for c in rows.columns if c not in keys]
    least = F.min_by(F.struct(*cols), F.struct(*order))
    has = F.lit(True)
    for k in keys:
        has = has & F.col(k).isNotNull()
    return rows.where(has).groupBy(*keys).agg(least.alias("x")).select(*keys, "x.*").unionByName(rows.where(~has).select(*keys, *cols))


def _relaxed(calls: Column) -> Column:
    """Levels of calls, an array of (call_id, refs); as many rounds as there are calls, after which only cycles still grow."""
    ids = F.transform(calls, lambda c: c["call_id"])
    refs = F.transform(calls, lambda c: F.transform(F.filter(c["refs"], lambda r: F.array_contains(ids, r)), lambda r: F.array_position(ids, r).cast("int")))
    both = F.struct(refs.alias("refs"), F.transform(calls, lambda c: F.lit(0)).alias("zero"))

    def run(b: Column) -> Column:
        step = lambda levels, _: F.transform(b["refs"], lambda own: F.aggregate(own, F.lit(0), lambda top, r: F.greatest(top, F.element_at(levels, r) + 1)))
        return F.aggregate(b["zero"], b["zero"], step)

    return F.element_at(F.transform(F.array(both), run), 1)


def _doubled(left: DataFrame, live: DataFrame) -> DataFrame:
    """Levels of calls with one reference at most, by pointer doubling: each round doubles the steps that a pointer stands for."""
    most = left.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    now = cut(live.select("conv_id", "call_id", F.col("ref").alias("to"), F.lit(1).alias("steps")), "call-pointers")
    for _ in range(most.bit_length()):  # after that only pointers on or into a cycle are left
        ahead = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        now = cut(now.join(ahead, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("next").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "call-pointers")
        if now.where("to is not null").isEmpty():
            break
    level = F.when(F.col("to").isNotNull(), -1).otherwise(F.coalesce("steps", F.lit(0))).cast("int")
    return left.join(now, ["conv_id", "call_id"], "left").select("conv_id", "call_id", level.alias("level"))


def _levels(calls: DataFrame, small: int) -> DataFrame:
    """level per call of conversations with a forward reference (-1: on or behind a cycle); others have none."""
    slim = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).select("conv_id", "call_id", "turn", "idx", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    refs = slim.select("conv_id", "call_id", "turn", "idx", F.explode(F.array_distinct("refs")).alias("ref"))
    target = slim.select("conv_id", F.col("call_id").alias("ref"), F.struct("turn", "idx").alias("at"))
    edges = cut(refs.join(target, ["conv_id", "ref"]).select("conv_id", "call_id", "ref", (F.col("at") >= F.struct("turn", "idx")).alias("forward")), "call-refs")
    twisted = edges.where("forward").select("conv_id").distinct()
    left = cut(slim.join(twisted, "conv_id", "left_semi").select("conv_id", "call_id", "refs"), "calls-left")
    size = left.groupBy("conv_id").agg(F.count("*").alias("n"))
    few = left.join(size.where(F.col("n") <= small), "conv_id").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "refs")).alias("calls"))
    few = few.select("conv_id", "calls", _relaxed(F.col("calls")).alias("levels")).select("conv_id", F.size("calls").alias("n"), F.explode(F.arrays_zip("calls", "levels")).alias("x"))
    done = [few.select("conv_id", F.col("x.calls.call_id").alias("call_id"), F.when(F.col("x.levels") >= F.col("n"), -1).otherwise(F.col("x.levels")).alias("level"))]
    left = cut(left.join(size.where(F.col("n") > small), "conv_id", "left_semi").select("conv_id", "call_id"), "calls-left")
    if left.isEmpty():
        return done[0]
    live = edges.join(left.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "call_id", "ref")
    many = cut(live.groupBy("conv_id", "call_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id").distinct(), "calls-many")
    done.append(_doubled(left.join(many, "conv_id", "left_anti"), live.join(many, "conv_id", "left_anti")))
    left, live = cut(left.join(many, "conv_id", "left_semi"), "calls-left"), live.join(many, "conv_id", "left_semi")
    # how many references of each call are still open; only what the last round freed is looked at
    open_ = live.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
    free, level = cut(left.join(open_, ["conv_id", "call_id"], "left_anti"), "calls-free"), 0
    open_ = cut(open_, "calls-open")
    while not free.isEmpty():
        done.append(free.select("conv_id", "call_id", F.lit(level).alias("level")))
        met = live.join(free.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("met"))
        now = cut(open_.join(met, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")), "calls-open")
        free, open_, level = now.where("n = 0").select("conv_id", "call_id"), now.where("n > 0"), level + 1
    done.append(open_.select("conv_id", "call_id", F.lit(-1).alias("level")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut(out, "call-levels")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas, small: int = SMALL) -> DataFrame:
    """conv_id, position, level, turn, call_id, name, status, errors, canonical_json: a row per call and orphan result.

    calls: conv_id, turn, idx, call_id, name, arguments (JSON text), refs array<string>;
    results: conv_id, turn, call_id, content. position counts a conversation's rows from 0, by
    (level, turn, idx, call_id); level is 0 unless a forward reference makes waiting necessary.
    """
    one = cut(_first(calls.select("conv_id", "call_id", "turn", "idx", "name", "arguments", "refs"), ["conv_id", "call_id"], [F.col("turn"), F.col("idx"), F.col("name"), F.col("arguments")]), "calls")
    answer = _first(results.select("conv_id", "call_id", "turn", "content"), ["conv_id", "call_id"], [F.col("turn"), F.col("content")]).withColumnRenamed("turn", "answered")
    both = typed(one).withColumn("asked", F.lit(True)).join(answer.withColumn("came", F.lit(True)), ["conv_id", "call_id"], "full")
    both = both.join(_levels(one, small), ["conv_id", "call_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    both = both.select(
        "conv_id",
        "call_id",
        "level",
        F.coalesce("turn", "answered").alias("turn"),
        F.coalesce("idx", F.lit(0)).alias("idx"),
        "name",
        F.when(F.col("came") & F.col("asked"), "linked").when(F.col("asked"), "unanswered").otherwise("orphan").alias("status"),
        F.when(F.col("asked"), violations(schemas)).otherwise(F.array().cast("array<string>")).alias("errors"),
        canonical().alias("canonical_json"),
    )
    both = cut(both.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)), "linked")
    named = both.where(F.col("conv_id").isNotNull())
    counts = named.groupBy("conv_id", "level", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("level", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "level", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "level", "block").orderBy("turn", "idx", "call_id", "canonical_json")
    ranked = named.withColumn("rn", F.row_number().over(within)).join(counts, ["conv_id", "level", "block"]).withColumn("position", (F.col("base") + F.col("rn") - 1).cast("long"))
    out = ["conv_id", "position", "level", "turn", "call_id", "name", "status", F.array_join("errors", "; ").alias("errors"), "canonical_json"]
    return ranked.select(*out).unionByName(both.where(F.col("conv_id").isNull()).withColumn("position", F.lit(None).cast("long")).select(*out))


#: The schema under which a plain user turn is read as a call.
TURN_SCHEMA: Schemas = {"say": {"text": ("string", True), "chars": ("integer", True)}}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain transcripts as calls and results: a user turn t is the call `say` with id `conv:t`, the assistant's turn t + 1 its result.

    Plain transcripts have neither references nor faults, so rules on their numbers give some, and
    every branch meets whole tables: by conv_id mod 3 a call refers to the one two turns before (0),
    two turns later (1), or the two refer to each other (2, a cycle); on odd turns `chars` is written
    as a string, and from turn 4 on there is a further argument. Texts that hold real tool JSON come
    through parse_calls and parse_results.
    """
    turn, kind = F.col("turn"), F.pmod(F.col("conv_id"), F.lit(3))
    key = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    user = messages.where(F.col("role") == "user")
    refers = F.when(kind == 0, turn - 2).when(kind == 1, turn + 2).otherwise(F.when(turn % 4 < 2, turn + 2).otherwise(turn - 2))
    n = F.length("text")
    number = F.when(turn % 2 == 0, n.cast("string")).otherwise(quoted(n.cast("string")))
    arguments = F.concat(F.lit('{"text":'), quoted(F.col("text")), F.lit(',"chars":'), F.coalesce(number, F.lit("null")), F.when(turn >= 4, F.lit(',"late":true')).otherwise(""), F.lit("}"))
    calls = user.select("conv_id", "turn", F.lit(0).alias("idx"), key(turn).alias("call_id"), F.lit("say").alias("name"), arguments.alias("arguments"), F.array(key(refers)).alias("refs"))
    results = messages.where(F.col("role") == "assistant").select("conv_id", "turn", key(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls.unionByName(parse_calls(messages)), results.unionByName(parse_results(messages))


#: link over turns_as_calls of a table `conversations` without tool JSON and with unique turns, in DuckDB's dialect. level comes from walking all chains.
SQL = """WITH RECURSIVE c AS (SELECT conv_id, turn, concat(conv_id, ':', turn) AS call_id, text, conv_id % 3 AS kind FROM conversations WHERE role = 'user'),
refs AS (SELECT conv_id, turn, CASE WHEN kind = 0 THEN turn - 2 WHEN kind = 1 THEN turn + 2 WHEN turn % 4 < 2 THEN turn + 2 ELSE turn - 2 END AS ref FROM c),
edges AS (SELECT r.* FROM refs r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.ref),
twisted AS (SELECT DISTINCT conv_id FROM edges WHERE ref > turn),
walk AS (SELECT conv_id, turn, ref, 1 AS steps FROM edges JOIN twisted USING (conv_id) UNION ALL SELECT w.conv_id, w.turn, e.ref, w.steps + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.turn = w.ref WHERE w.steps < 100),
levels AS (SELECT conv_id, turn, CASE WHEN max(steps) >= 100 THEN -1 ELSE max(steps) END AS level FROM walk GROUP BY 1, 2),
a AS (SELECT conv_id, turn - 1 AS turn, turn AS answered, text AS content FROM conversations WHERE role = 'assistant'),
j AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.turn, a.answered) AS turn, concat(coalesce(c.conv_id, a.conv_id), ':', coalesce(c.turn, a.turn)) AS call_id, CASE WHEN c.turn IS NOT NULL THEN 'say' END AS name,
CASE WHEN c.turn IS NULL THEN 'orphan' WHEN a.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, coalesce(level, 0) AS level, c.text, a.content, c.turn AS asked FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.turn = a.turn LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) - 1 AS position, turn, call_id, name, status,
CASE WHEN asked IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN asked % 2 = 1 THEN 'chars is not integer' END, CASE WHEN text IS NULL THEN 'text is not string' END, CASE WHEN asked >= 4 THEN 'unknown late' END) END AS errors,
concat('{"arguments":', CASE WHEN asked IS NULL THEN '{}' ELSE concat('{"chars":', CASE WHEN asked % 2 = 0 THEN length(text)::VARCHAR ELSE to_json(length(text)::VARCHAR)::VARCHAR END, CASE WHEN asked >= 4 THEN ',"late":true' ELSE '' END, ',"text":', to_json(text)::VARCHAR, '}') END,
',"id":', to_json(call_id)::VARCHAR, ',"name":', CASE WHEN name IS NULL THEN 'null' ELSE '"say"' END, ',"result":', coalesce(to_json(content)::VARCHAR, 'null'), '}') AS canonical_json FROM j"""
