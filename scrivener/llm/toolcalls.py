"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results are tables of messages with an identifier. They are hash-joined on (conversation, identifier); a call
may name calls that must come before it, and calls are put in a topological order: by time in conversations where time
respects every reference, else by depth (the longest chain of references below a call), then by time. Arguments are
validated against JSON schemas, and each call with its result becomes one line of canonical JSON: keys sorted, no
spaces, non-ASCII kept.

Only the references of conversations that time doesn't order are sorted at all. A conversation of at most GROUP of them
is sorted by one task, which gets identifiers alone. In larger ones depths are found together for all: where no call
names more than one other, by jumping along references over twice as many each round; else by removing the calls that
wait for nothing, round by round, as many rounds as the longest chain. Texts of a conversation are never gathered:
every row is one call, so one that holds a third of all messages costs no more than others, and places in it are counted
in two levels.

Defined results: of calls (or results) that share conversation and identifier the least (turn, payload) counts and
`copies` says how many there were; a reference to an identifier that has no call is none; a result without a call has
status "orphan", a call without a result "unanswered"; calls on a cycle or behind one are invalid and come last; null ids,
turns, roles and texts are values of their own (written as "-", or as null); an empty table gives an empty table; other
columns don't matter.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import LEAST_ID, Written, real_id

#: Turns in a counting bucket.
SPAN = 64
#: References of a conversation that one task sorts.
GROUP = 50_000
LAST = 2**31 - 1

SCHEMAS = {
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """Violations of type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    out, kind = [], schema.get("type")
    if kind in ("integer", "number"):
        ok = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    else:
        ok = kind is None or isinstance(value, _TYPES[kind])
    if not ok:
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += schema_errors(x, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of bounds")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _written(schemas: dict):
    def one(call_id, name, arguments, result, status, level):
        errors = []
        try:
            args = json.loads(arguments) if arguments is not None else None
        except ValueError:
            args, errors = arguments, ["$: not JSON"]
        if status == "orphan":
            errors = ["no call"]
        elif not errors:
            errors = schema_errors(args, schemas[name]) if name in schemas else ["unknown tool"]
        if level == LAST:
            errors = [*errors, "cycle"]
        return canonical({"arguments": args, "id": call_id, "name": name, "result": result}), ";".join(errors)

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            made = [one(*x) for x in zip(*(cols[i] for i in (1, 4, 5, 6, 7, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(4), b.column(7), b.column(8), b.column(9), pa.array([not e for _, e in made], pa.bool_()), pa.array([e for _, e in made], pa.string()), pa.array([j for j, _ in made], pa.string())],
                ["_conv", "call_id", "_turn", "name", "status", "copies", "position", "valid", "errors", "json"],
            )

    return run


def depths(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Depth (1 without references) of every call that edges (own, dep) name; LAST on or behind a cycle."""
    waits, behind = Counter(), defaultdict(list)
    for own, dep in edges:
        waits[own] += 1
        behind[dep].append(own)
    found = {dep: 1 for dep in behind if dep not in waits}
    ready = list(found)
    for dep in ready:
        for own in behind.get(dep, ()):
            found[own] = max(found.get(own, 1), found[dep] + 1)
            waits[own] -= 1
            if not waits[own]:
                ready.append(own)
    done = set(ready)
    return {c: found[c] if c in done else LAST for c in {*waits, *behind}}


def _sorted(batches):
    for b in batches:
        for conv, edges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = depths([(e["own"], e["dep"]) for e in edges])
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(found.values(), pa.int32())], ["_conv", "call_id", "level"])


def _jumped(edges: DataFrame) -> DataFrame:
    """(_conv, call_id, level) where every call has one reference: each round a call's reference becomes that of its
    reference, until it is one that has none."""
    now, n, reach = Written(edges.select("_conv", "own", F.col("dep").alias("far"), F.lit(1).alias("far_by")), "jumps"), edges.count(), 1
    while reach <= 2 * n:
        next_ = now.df.select("_conv", F.col("own").alias("far"), F.col("far").alias("further"), F.col("far_by").alias("more"))
        joined = now.df.join(next_, ["_conv", "far"], "left")
        after = Written(joined.select("_conv", "own", F.coalesce("further", "far").alias("far"), F.least(F.col("far_by") + F.coalesce("more", F.lit(0)), F.lit(LAST // 2)).alias("far_by")), "jumps")
        now.drop()
        now, reach = after, 2 * reach
    # what still points at a call with a reference goes round a cycle
    turning = now.df.join(now.df.select("_conv", F.col("own").alias("far")), ["_conv", "far"], "left_semi").select("_conv", "own").withColumn("_turns", F.lit(True))
    own = now.df.join(turning, ["_conv", "own"], "left").select("_conv", F.col("own").alias("call_id"), F.when(F.col("_turns"), F.lit(LAST)).otherwise(F.col("far_by") + 1).alias("level"))
    return own


def _removed(edges: DataFrame) -> DataFrame:
    """(_conv, call_id, level): round by round the calls that wait for nothing go."""
    now, level, waiting = Written(edges, "open"), 1, None
    left = now.df.count()
    while True:
        blocked = now.df.select("_conv", F.col("own").alias("dep")).distinct()
        after = Written(now.df.join(blocked, ["_conv", "dep"], "left_semi").select("_conv", "own", "dep"), "open")
        rest = after.df.count()
        # a call whose references all go now comes right after them
        here = now.df.select("_conv", F.col("own").alias("call_id")).distinct().withColumn("level", F.lit(LAST if rest == left else level + 1))
        waiting = here if waiting is None else waiting.union(here)
        if rest in (0, left):
            return waiting.groupBy("_conv", "call_id").agg(F.max("level").alias("level"))
        now, left, level = after, rest, level + 1


def _levels(calls: DataFrame) -> DataFrame:
    """(_conv, call_id, level): 0 wherever time respects all references of a conversation; else depths, LAST on or behind cycles."""
    ref = calls.select("_conv", F.col("call_id").alias("own"), F.col("turn").alias("own_turn"), F.explode("after").alias("call_id"))
    edges = Written(ref.join(calls.select("_conv", "call_id", "turn"), ["_conv", "call_id"]).select("_conv", "own", "own_turn", F.col("call_id").alias("dep"), "turn").distinct(), "references")
    late = F.struct(F.col("turn"), F.col("dep")) >= F.struct(F.col("own_turn"), F.col("own"))
    many = edges.df.groupBy("_conv", "own").agg(F.count("*").alias("k"), F.max(late).alias("late"))
    convs = Written(many.groupBy("_conv").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max("late").alias("late")).filter("late").drop("late"), "unordered")
    open_ = edges.df.select("_conv", "own", "dep")
    of = lambda cond: open_.join(convs.df.filter(cond).select("_conv"), "_conv", "left_semi")
    small = of(F.col("n") <= GROUP).groupBy("_conv").agg(F.collect_list(F.struct("own", "dep")).alias("edges"))
    found = small.mapInArrow(_sorted, "_conv bigint, call_id string, level int")
    for cond, way in ((F.col("most") == 1, _jumped), (F.col("most") > 1, _removed)):
        large = (F.col("n") > GROUP) & cond
        if not convs.df.filter(large).isEmpty():
            found = found.union(way(of(large)))
    every = calls.select("_conv", "call_id").join(convs.df.select("_conv", F.lit(1).alias("_late")), "_conv", "left").join(found, ["_conv", "call_id"], "left")
    return every.select("_conv", "call_id", F.coalesce("level", "_late", F.lit(0)).alias("level"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row for each (conversation, identifier). calls: _conv, call_id, turn, name, arguments (JSON), after (identifiers);
    results: _conv, call_id, turn, content."""
    c = calls.groupBy("_conv", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("nc")).select("_conv", "call_id", "c.*", "nc")
    r = results.groupBy("_conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("nr"))
    r = r.select("_conv", "call_id", F.col("r.turn").alias("result_turn"), "r.content", "nr")
    both = Written(c.join(r.hint("shuffle_hash"), ["_conv", "call_id"], "full"), "linked").df
    levels = _levels(both.filter("nc IS NOT NULL").select("_conv", "call_id", "turn", "after"))
    status = F.when(F.col("nc").isNull(), "orphan").when(F.col("nr").isNull(), "unanswered").otherwise("linked")
    rows = both.join(levels, ["_conv", "call_id"], "left").select(
        "_conv", "call_id", F.coalesce("turn", "result_turn").alias("_turn"), F.coalesce("level", F.lit(0)).alias("_level"), "name", "arguments", "content", status.alias("status"),
        F.greatest(F.coalesce("nc", F.lit(0)), F.coalesce("nr", F.lit(0))).alias("copies"),
    )
    rows = rows.withColumn("_span", F.floor(F.col("_turn") / SPAN))
    inside = F.row_number().over(Window.partitionBy("_conv", "_level", "_span").orderBy("_turn", "call_id"))
    sizes = rows.groupBy("_conv", "_level", "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_conv").orderBy("_level", "_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_conv", "_level", "_span", before.alias("_before"))
    placed = rows.withColumn("_in", inside).join(starts, ["_conv", "_level", "_span"]).withColumn("position", (F.col("_before") + F.col("_in")).cast("bigint"))
    out = placed.select("_conv", "call_id", "_turn", "_level", "name", "arguments", "content", "status", "copies", "position")
    return out.mapInArrow(_written(schemas), "_conv bigint, call_id string, _turn bigint, name string, status string, copies bigint, position bigint, valid boolean, errors string, json string")


def from_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: a user's turn asks, a system turn configures, an assistant's turn t is the
    result for the call of turn t - 1. Of two calls that are two turns apart the shorter waits for the longer, whose text it
    builds on, and of equally long ones the second for the first (of copies of a call the longest text counts)."""
    conv = F.coalesce(messages["conv_id"].cast("bigint"), F.lit(LEAST_ID)).alias("_conv")
    turn = F.coalesce(messages["turn"].cast("bigint"), F.lit(-1))
    prefix = F.coalesce(messages["conv_id"].cast("string"), F.lit("-"))
    named = lambda p, t: F.concat_ws(":", p, t.cast("string"))
    said = messages["text"].cast("string")
    text = F.when(said.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(said.alias("t"))), r'^\{"t":(?s)(.*)\}$', "$1"))
    arguments = F.concat(F.lit('{"text":'), text, F.lit(',"turn":'), turn.cast("string"), F.lit("}"))
    calls = messages.filter("coalesce(role, '') <> 'assistant'").select(conv, prefix.alias("_prefix"), named(prefix, turn).alias("call_id"), turn.alias("turn"), F.when(F.col("role") == "system", "configure").otherwise("ask").alias("name"), arguments.alias("arguments"), F.coalesce(F.length(said), F.lit(0)).alias("_n"))
    at = lambda shift, name: F.struct((F.col("turn") + shift).alias("turn"), *(F.when(F.lit(c == name), F.col("_n")).alias(c) for c in ("own", "before", "behind")))
    lengths = calls.select("_conv", F.explode(F.array(at(0, "own"), at(2, "before"), at(-2, "behind"))).alias("x")).groupBy("_conv", "x.turn").agg(*(F.max(f"x.{c}").alias(c) for c in ("own", "before", "behind")))
    waits = F.array_compact(F.array(F.when(F.col("own") <= F.col("before"), named(F.col("_prefix"), F.col("turn") - 2)), F.when(F.col("own") < F.col("behind"), named(F.col("_prefix"), F.col("turn") + 2))))
    calls = calls.join(lengths, ["_conv", "turn"]).select("_conv", "call_id", "turn", "name", "arguments", waits.alias("after"))
    results = messages.filter("role = 'assistant'").select(conv, named(prefix, turn - 1).alias("call_id"), turn.alias("turn"), said.alias("content"))
    return calls, results


def query(messages: DataFrame) -> DataFrame:
    done = linked_calls(*from_conversations(messages))
    return done.select(real_id("_conv").alias("conv_id"), "call_id", "position", "name", "status", "copies", "valid", "errors", "json")


ORACLE = """
WITH m AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '-') AS cs, conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations),
c AS (SELECT conv_id, cs || ':' || turn AS call_id, turn, CASE WHEN role = 'system' THEN 'configure' ELSE 'ask' END AS name, text FROM m WHERE coalesce(role, '') <> 'assistant'),
r AS (SELECT conv_id, cs || ':' || (turn - 1) AS call_id, turn, text FROM m WHERE role = 'assistant'),
c1 AS (SELECT conv_id, call_id, turn, name, text, n, len FROM (SELECT *, count(*) OVER w AS n, max(coalesce(length(text), 0)) OVER w AS len,
       row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, text IS NULL, text) AS k FROM c WINDOW w AS (PARTITION BY conv_id, call_id)) WHERE k = 1),
r1 AS (SELECT conv_id, call_id, turn, text, n FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text NULLS FIRST) AS k FROM r WINDOW w AS (PARTITION BY conv_id, call_id)) WHERE k = 1),
e AS (SELECT *, turn % 2 AS odd, coalesce(lag(turn) OVER w = turn - 2 AND len <= lag(len) OVER w, false) AS up, coalesce(lead(turn) OVER w = turn + 2 AND len < lead(len) OVER w, false) AS down
      FROM c1 WINDOW w AS (PARTITION BY conv_id, abs(turn % 2) ORDER BY turn)),
-- a run of calls that each wait for the one before (or behind): depth is the place in the longer of the two
g AS (SELECT *, count(*) FILTER (WHERE NOT up) OVER (PARTITION BY conv_id, abs(odd) ORDER BY turn) AS ups, count(*) FILTER (WHERE NOT down) OVER (PARTITION BY conv_id, abs(odd) ORDER BY turn DESC) AS downs,
      bool_or(down) OVER (PARTITION BY conv_id) AS late FROM e),
d AS (SELECT conv_id, call_id, CASE WHEN late THEN greatest(row_number() OVER (PARTITION BY conv_id, abs(odd), ups ORDER BY turn), row_number() OVER (PARTITION BY conv_id, abs(odd), downs ORDER BY turn DESC)) ELSE 0 END AS level FROM g),
j AS (SELECT coalesce(c1.conv_id, r1.conv_id) AS conv_id, coalesce(c1.call_id, r1.call_id) AS call_id, coalesce(c1.turn, r1.turn) AS turn, c1.turn AS ct,
             c1.name, c1.text AS ask, r1.text AS answer, c1.n AS cn, r1.n AS rn
      FROM c1 FULL JOIN r1 ON c1.conv_id IS NOT DISTINCT FROM r1.conv_id AND c1.call_id = r1.call_id),
l AS (SELECT j.*, coalesce(level, 0) AS level FROM j LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM j.conv_id AND d.call_id = j.call_id)
SELECT conv_id, call_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) AS BIGINT) AS position, name,
       CASE WHEN cn IS NULL THEN 'orphan' WHEN rn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CAST(greatest(coalesce(cn, 0), coalesce(rn, 0)) AS BIGINT) AS copies,
       coalesce(cn IS NOT NULL AND length(ask) > 0 AND ct >= 0 AND (name = 'ask' OR ct = 0), false) AS valid,
       CASE WHEN cn IS NULL THEN 'no call' ELSE concat_ws(';', CASE WHEN ask IS NULL THEN '$.text: not string' WHEN length(ask) = 0 THEN '$.text: too short' END,
            CASE WHEN ct < 0 OR (name = 'configure' AND ct > 0) THEN '$.turn: out of bounds' END) END AS errors,
       '{"arguments":' || CASE WHEN cn IS NULL THEN 'null' ELSE '{"text":' || coalesce(CAST(to_json(ask) AS VARCHAR), 'null') || ',"turn":' || ct || '}' END
       || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null')
       || ',"result":' || coalesce(CAST(to_json(answer) AS VARCHAR), 'null') || '}' AS json
FROM l
"""
