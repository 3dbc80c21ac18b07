"""Tool-call linking for chat formatting.

Calls and results are hash-joined by conversation and identifier, arguments are checked
against their tool's schema, calls are put in an order in which each follows those it depends on,
and a linked pair is written as canonical JSON.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, rows

#: Turns of a conversation that one task numbers.
TURNS = 512
#: Places of a conversation that one task looks at.
SPAN = 65_536
NO_TURN = 2**62


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and no escapes beyond the required ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _reject(token: str) -> None:
    raise ValueError(f"{token} is not JSON")


def parse(text: str | None) -> object:
    """Strict JSON; a repeated key is an error."""

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    def number(text: str) -> float:
        value = float(text)
        if not math.isfinite(value):
            raise ValueError(f"{text} is out of range")
        return value

    return json.loads(text or "", parse_constant=_reject, object_pairs_hook=pairs, parse_float=number)


TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or value == math.floor(value))
    return isinstance(value, TYPES[kind])


def equal(a: object, b: object) -> bool:
    """Equal as JSON: 1 is 1.0, but no number is a boolean."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b or _is(a, "number") and _is(b, "number") and a == b


def _bounds(value: float, schema: dict) -> list[str]:
    checks = {"minimum": lambda x: value < x, "maximum": lambda x: value > x, "exclusiveMinimum": lambda x: value <= x, "exclusiveMaximum": lambda x: value >= x, "multipleOf": lambda x: value % x != 0}
    return [k for k, bad in checks.items() if k in schema and bad(schema[k])]


def _sizes(value: object, schema: dict, least: str, most: str) -> list[str]:
    return [k for k, bad in ((least, len(value) < schema.get(least, 0)), (most, len(value) > schema.get(most, len(value)))) if bad]


#: Keywords that say nothing on whether a value is valid, and those that are checked.
NOTES = ("title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly", "format")
CHECKED = (
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties",
    "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "anyOf", "oneOf", "allOf", "not",
)


def violations(value: object, schema: dict | bool, path: str = "$") -> list[str]:
    """What in ``value`` breaks the schema, and each keyword that isn't known here: nothing passes unchecked."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: false"]
    out = [f"{path}: unsupported {k}" for k in sorted(schema) if k not in NOTES and k not in CHECKED]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if unknown := [k for k in kinds if k not in (*TYPES, "integer", "number")]:
        return [*out, f"{path}: unsupported type {unknown[0]}"]
    if kinds and not any(_is(value, k) for k in kinds):
        return [*out, f"{path}: type"]
    if "enum" in schema and not any(equal(value, x) for x in schema["enum"]):
        out.append(f"{path}: enum")
    if "const" in schema and not equal(value, schema["const"]):
        out.append(f"{path}: const")
    if _is(value, "number"):
        out += [f"{path}: {k}" for k in _bounds(value, schema)]
    if isinstance(value, str):
        out += [f"{path}: {k}" for k in _sizes(value, schema, "minLength", "maxLength")]
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: pattern")
    if isinstance(value, dict):
        out += [f"{path}: {k}" for k in _sizes(value, schema, "minProperties", "maxProperties")]
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif more is False:
                out.append(f"{path}.{k}: additional")
            else:
                out += violations(value[k], more, f"{path}.{k}")
    if isinstance(value, list):
        out += [f"{path}: {k}" for k in _sizes(value, schema, "minItems", "maxItems")]
        if schema.get("uniqueItems") and any(equal(x, y) for i, x in enumerate(value) for y in value[:i]):
            out.append(f"{path}: uniqueItems")
        for i, x in enumerate(value if "items" in schema else ()):
            out += violations(x, schema["items"], f"{path}[{i}]")
    fits = lambda some: sum(not violations(value, x, path) for x in some)
    out += [f"{path}: {k}" for k, bad in (("anyOf", lambda x: not fits(x)), ("oneOf", lambda x: fits(x) != 1), ("not", lambda x: bool(fits([x])))) if k in schema and bad(schema[k])]
    for x in schema.get("allOf", ()):
        out += violations(value, x, path)
    return out


def _before(rows: DataFrame, slice_: str, what: F.Column) -> DataFrame:
    """``c, s, before``: for each slice of a conversation the total of ``what`` over its earlier slices."""
    sizes = rows.groupBy("conv_id", slice_).agg(what.alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col("conv_id").alias("c"), F.col(slice_).alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def numbered(rows: DataFrame, slice_: F.Column, order: list[str], name: str) -> DataFrame:
    """``name``: rank by ``order`` in the conversation, counted in slices of it, so that a long
    conversation isn't ordered in one task."""
    cut = rows.withColumn("__slice", slice_)
    local = cut.withColumn("__near", F.row_number().over(Window.partitionBy("conv_id", "__slice").orderBy(*order)))
    before = _before(cut, "__slice", F.count("*"))
    joined = local.join(before, local["conv_id"].eqNullSafe(before["c"]) & (local["__slice"] == before["s"]))
    return joined.withColumn(name, F.col("before") + F.col("__near") - 1).drop("__slice", "__near", "before", "c", "s")


def _latest(rows: DataFrame, value: str, order: list[str], include: int) -> DataFrame:
    """``seen``: the greatest ``value`` of the conversation's rows before each (``include`` -1) or up to it (0), by slices of ``at``."""
    cut = rows.withColumn("__slice", F.floor(F.col("at") / SPAN))
    by = Window.partitionBy("conv_id", "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, include)
    tops = cut.groupBy("conv_id", "__slice").agg(F.max(value).alias("top"))
    earlier = Window.partitionBy("conv_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("conv_id").alias("c"), F.col("__slice").alias("s"), F.max("top").over(earlier).alias("carry"))
    local = cut.withColumn("__near", F.max(value).over(by))
    joined = local.join(tops, local["conv_id"].eqNullSafe(tops["c"]) & (local["__slice"] == tops["s"]))
    return joined.withColumn("seen", F.greatest("carry", "__near")).drop("__slice", "__near", "carry", "c", "s")


def components(n: int, after: list[list[int]]) -> list[int]:
    """The strongly connected component of each node, by one depth-first pass with a stack of its own."""
    number, low, on, stack, out = [-1] * n, [0] * n, [False] * n, [], [-1] * n
    count = parts = 0
    for root in range(n):
        if number[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                number[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            for j in range(i, len(after[v])):
                w = after[v][j]
                if number[w] < 0:
                    work += [(v, j + 1), (w, 0)]
                    break
                if on[w]:
                    low[v] = min(low[v], number[w])
            else:
                if low[v] == number[v]:
                    while True:
                        w = stack.pop()
                        on[w] = False
                        out[w] = parts
                        if w == v:
                            break
                    parts += 1
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return out


def order_run(places: np.ndarray, needs: np.ndarray) -> tuple[list[int], list[int], list[int], list[bool]]:
    """(places, latest place that each waits for, number within the run, on a cycle) of the calls of a run's dependencies.

    Least-place-first topological order; calls on a cycle go without their dependencies on each other.
    """
    names, at = np.unique(np.concatenate([places, needs]), return_inverse=True)
    n = len(names)
    pairs = sorted(set(zip(at[: len(places)].tolist(), at[len(places) :].tolist())))
    after: list[list[int]] = [[] for _ in range(n)]
    for a, b in pairs:
        after[b].append(a)
    part = components(n, after)
    size = Counter(part)
    cyclic = [size[p] > 1 for p in part]
    missing, deps = [0] * n, [[] for _ in range(n)]
    for a, b in pairs:
        if a == b:
            cyclic[a] = True
        if part[a] != part[b]:
            missing[a] += 1
            deps[a].append(b)
    ready = [i for i in range(n) if not missing[i]]
    heapq.heapify(ready)
    latest, number = list(range(n)), [0] * n
    for k in range(n):
        i = heapq.heappop(ready)
        number[i] = k
        latest[i] = max([i, *(latest[d] for d in deps[i])])
        for j in after[i]:
            if part[i] != part[j]:
                missing[j] -= 1
                if not missing[j]:
                    heapq.heappush(ready, j)
    names = names.tolist()
    return names, [names[i] for i in latest], number, cyclic


def topological(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, place, topo, cyclic``: the order that takes the earliest ready call next.

    ``place`` is the rank by (turn, call_id).  A call on a cycle is ``cyclic`` and goes without its dependencies on the others of the cycle, so
    every call has a ``topo``, those behind a cycle too; unknown dependencies are passed over.

    Where every dependency lies earlier, the order is the place itself.  A dependency on a later call spans a run
    of places; overlapping spans are one run, and cycles lie within a run.  Only the dependencies inside a run are gathered, as
    pairs of numbers, a run at a time; its calls without any aren't.  What comes back is the latest place that a call waits for: by it, and within it by the run's order,
    all calls are numbered in slices.
    """
    placed = materialise(numbered(calls.select("conv_id", "call_id", "turn", "depends_on"), F.floor(F.col("turn") / TURNS), ["turn", "call_id"], "place"))
    needs = placed.select("conv_id", "place", F.explode("depends_on").alias("need"))
    at = placed.select(F.col("conv_id").alias("c"), F.col("call_id").alias("need"), F.col("place").alias("need_place"))
    edges = materialise(needs.join(at, needs["conv_id"].eqNullSafe(at["c"]) & (needs["need"] == at["need"])).select("conv_id", "place", "need_place"))
    late = edges.where("need_place >= place")
    if late.isEmpty():
        return placed.select("conv_id", "call_id", "place", F.col("place").alias("topo"), F.lit(False).alias("cyclic"))
    # Spans by where they begin; one that begins behind all before it opens a run.
    spans = late.groupBy("conv_id", F.col("place").alias("at")).agg(F.max("need_place").alias("high"))
    opened = _latest(spans, "high", ["at"], -1).withColumn("low", F.when(F.col("seen").isNull() | (F.col("at") > F.col("seen")), F.col("at"))).drop("seen")
    runs = materialise(_latest(opened, "low", ["at"], 0).groupBy("conv_id", F.col("seen").alias("at")).agg(F.max("high").alias("high")))
    # Each dependency meets the last run that begins at or before it.
    lows = edges.select("conv_id", F.least("place", "need_place").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<at:bigint,high:bigint>").alias("run"), "place", "need_place")
    starts = runs.select("conv_id", "at", F.lit(0).alias("kind"), F.struct("at", "high").alias("run"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("need_place"))
    met = _latest(lows.unionByName(starts), "run", ["at", "kind"], 0).where("kind = 1 and seen is not null")
    inside = met.where("greatest(place, need_place) <= seen.high").select("conv_id", F.col("seen.at").alias("run"), "place", "need_place")
    kind = dict(placed.dtypes)["conv_id"]

    def order(group: pa.Table) -> pa.Table:
        places, latest, number, cyclic = order_run(group.column("place").to_numpy(), group.column("need_place").to_numpy())
        conv = pa.chunked_array([group.column("conv_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(places)))])
        return pa.table({"conv_id": conv, "place": pa.array(places, pa.int64()), "latest": pa.array(latest, pa.int64()), "number": pa.array(number, pa.int64()), "cyclic": pa.array(cyclic, pa.bool_())})

    sorted_ = inside.groupBy("conv_id", "run").applyInArrow(order, f"conv_id {kind}, place long, latest long, number long, cyclic boolean")
    sorted_ = sorted_.select(F.col("conv_id").alias("o"), F.col("place").alias("p"), "latest", "number", "cyclic")
    both = placed.join(sorted_, placed["conv_id"].eqNullSafe(sorted_["o"]) & (placed["place"] == sorted_["p"]), "left")
    keyed = materialise(both.select("conv_id", "call_id", "place", F.coalesce("latest", "place").alias("latest"), F.coalesce("number", F.lit(0)).alias("number"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")))
    return numbered(keyed, F.floor(F.col("latest") / SPAN), ["latest", "number"], "topo").select("conv_id", "call_id", "place", "topo", "cyclic")


LINKED = "n_calls long, n_results long, n_dangling long, valid boolean, errors array<string>, json string"


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per identifier of a conversation, and one per row without identifier.

    ``calls``: ``conv_id, call_id, turn, name, arguments`` (JSON text), ``depends_on
    array<string>``; ``results``: ``conv_id, call_id, turn, content``; other columns are not read.
    ``schemas`` maps a tool's name to its argument schema.  Returns ``conv_id, call_id,
    turn, name, status, topo, n_calls, n_results, n_dangling, valid, errors, json``.  ``status`` is ``linked``,
    ``unanswered`` (no result), ``orphan_result`` (no call), ``no_identifier`` or, over
    the first two, ``cycle``.  Of several calls or results of an identifier the first by turn and content is linked, with the number of all rows;
    each other one that differs from it has a row of its own, checked and written like any, as ``repeated_call`` or ``repeated_result`` with the number of its equal rows.
    A result before its call is linked all the same.  Null arguments, unknown tools, broken JSON (lone surrogates too) and
    schema violations are errors and make ``valid`` false.  Null turns come last.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    calls = calls.select("conv_id", "call_id", turn.alias("turn"), "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = results.select("conv_id", "call_id", turn.alias("turn"), "content")

    def first(rows: DataFrame, columns: list[str], n: str) -> tuple[DataFrame, DataFrame]:
        """The first row of each identifier, and the others that differ from it, equal ones once."""
        once = materialise(rows.where("call_id is not null").groupBy("conv_id", "call_id", *columns).agg(F.count("*").alias("times")))
        one = materialise(once.groupBy("conv_id", "call_id").agg(F.min(F.struct(*columns)).alias("one"), F.sum("times").alias(n), F.count("*").alias("forms")))
        several = one.where("forms > 1").select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call"), F.col("one").alias("f_one"))
        more = once.join(several, once["conv_id"].eqNullSafe(several["f_conv"]) & (once["call_id"] == several["f_call"])).where(~F.struct(*columns).eqNullSafe(F.col("f_one")))
        return one.drop("forms"), more

    one_call, more_calls = first(calls, ["turn", "name", "arguments", "depends_on"], "n_calls")
    one_result, more_results = first(results, ["turn", "content"], "n_results")
    one_call, one_result = one_call.withColumnRenamed("one", "call"), one_result.withColumnRenamed("one", "result")
    order = topological(one_call.select("conv_id", "call_id", "call.turn", "call.depends_on"))
    ids = one_call.select(F.col("conv_id").alias("c"), F.col("call_id").alias("need"), F.lit(1).alias("there"))
    needs = one_call.select("conv_id", "call_id", F.explode(F.array_distinct("call.depends_on")).alias("need"))
    unmet = needs.join(ids, needs["conv_id"].eqNullSafe(ids["c"]) & (needs["need"] == ids["need"]), "left").where("there is null")
    unmet = unmet.groupBy(F.col("conv_id").alias("u_conv"), F.col("call_id").alias("u_call")).agg(F.count("*").alias("n_dangling"))
    o = order.select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_call"), "topo", "cyclic")
    r = one_result.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), "result", "n_results")
    c = one_call.join(o, one_call["conv_id"].eqNullSafe(o["o_conv"]) & (one_call["call_id"] == o["o_call"]))
    c = c.join(unmet, c["conv_id"].eqNullSafe(unmet["u_conv"]) & (c["call_id"] == unmet["u_call"]), "left")
    both = c.join(r.hint("shuffle_hash"), c["conv_id"].eqNullSafe(r["r_conv"]) & (c["call_id"] == r["r_call"]), "full_outer")
    has_call, has_result = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    status = F.when(~has_call, "orphan_result").when(F.col("cyclic"), "cycle").when(has_result, "linked").otherwise("unanswered")
    n = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    linked = both.select(
        F.when(has_call, F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"), F.coalesce("call.turn", "result.turn").alias("turn"), "call.name",
        status.alias("status"), "topo", "call.arguments", "result.content", n("n_calls"), n("n_results"), n("n_dangling"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = lambda rows, status, times: rows.select("conv_id", "call_id", "turn", *(["name"] if "name" in rows.columns else [null("string")]), F.lit(status), null("long"), *(["arguments", null("string"), times, zero, zero] if "name" in rows.columns else [null("string"), "content", zero, times, zero]))
    loose = alone(calls.where("call_id is null"), "no_identifier", one).union(alone(results.where("call_id is null"), "no_identifier", one))
    loose = loose.union(alone(more_calls, "repeated_call", F.col("times"))).union(alone(more_results, "repeated_result", F.col("times")))

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 2048):
            col = {x: batch.column(i).to_pylist() for i, x in enumerate(batch.schema.names)}
            valid, errors, texts = [], [], []
            for call_id, name, arguments, content, n_calls, n_results in zip(*(col[x] for x in ("call_id", "name", "arguments", "content", "n_calls", "n_results"))):
                out: dict = {"id": call_id}
                wrong: list[str] = []
                if n_calls:
                    out["name"] = name
                    try:
                        out["arguments"] = value = parse(arguments)
                        canonical(value).encode()
                        wrong = ["unknown tool"] if name not in schemas else violations(value, schemas[name])
                    except (ValueError, RecursionError):
                        out["arguments"] = arguments
                        wrong = ["broken JSON"]
                if n_results:
                    out["result"] = content
                valid.append(bool(n_calls) and not wrong)
                errors.append(wrong)
                texts.append(canonical(out))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(x)) for x in ("conv_id", "call_id", "turn", "name", "status", "topo", "n_calls", "n_results", "n_dangling")), pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=["conv_id", "call_id", "turn", "name", "status", "topo", "n_calls", "n_results", "n_dangling", "valid", "errors", "json"],
            )

    kind = dict(calls.dtypes)
    rows_ = linked.union(loose)
    shown = F.when(F.col("turn") != NO_TURN, F.col("turn")).alias("turn")
    out = rows_.select("conv_id", "call_id", shown, "name", "status", "topo", "arguments", "content", "n_calls", "n_results", "n_dangling")
    return out.mapInArrow(serialise, f"conv_id {kind['conv_id']}, call_id {kind['call_id']}, turn long, name string, status string, topo long, {LINKED}")


#: The tools of the plain conversations, one a role, and the schema of their arguments.
_TURN = {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "n_chars": {"type": "integer", "minimum": 1}}}
TOOLS = {"ask": _TURN, "answer": _TURN, "configure": _TURN}


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row is a call of its role's tool, and a result of the call of the turn before; k is conv_id + turn.

    ========  =====================================================================
    k % 5     1: depends on the call two turns later; 2, 4: on the one of the turn before
    k % 25    3: depends on the call two turns before, which makes a cycle with it
    k % 7     0: depends on a call that isn't there
    k % 11    3: the call has no identifier
    k % 13    5: the call has the identifier of the turn before
    k % 17    2: broken arguments; 5: ``turn`` is a text; 9: no ``text``; 12: unknown tool; 14: no arguments
    k % 19    4: the result has no identifier; 8: that of a call that isn't there
    k % 23    6: the result has the identifier of two turns before
    ========  =====================================================================

    Null turns or conversations leave k null: then none of this applies.
    """
    call = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    turn, k = F.col("turn"), F.col("conv_id") + F.col("turn")
    pick = lambda *cases: F.filter(F.array(*(F.when(when, call(to)) for when, to in cases)), lambda x: x.isNotNull())
    depends = pick((k % 5 == 1, turn + 2), (k % 5 == 2, turn - 1), (k % 5 == 4, turn - 1), (k % 25 == 3, turn - 2), (k % 7 == 0, turn + 1000))
    plain = lambda number, *more: F.to_json(F.struct(number.alias("turn"), *more, F.length("text").alias("n_chars")))
    text = F.col("text")
    arguments = F.when(k % 17 == 2, F.lit('{"text":')).when(k % 17 == 5, plain(turn.cast("string"), text)).when(k % 17 == 9, plain(turn)).when(k % 17 == 14, F.lit(None)).otherwise(plain(turn, text))
    name = F.when(k % 17 == 12, "other").when(F.col("role") == "user", "ask").when(F.col("role") == "assistant", "answer").otherwise("configure")
    call_id = F.when(k % 11 == 3, F.lit(None)).when((k % 13 == 5) & (turn >= 1), call(turn - 1)).otherwise(call(turn))
    result_id = F.when(k % 19 == 4, F.lit(None)).when(k % 19 == 8, call(turn + 500)).when(k % 23 == 6, call(turn - 2)).otherwise(call(turn - 1))
    calls = conversations.select("conv_id", call_id.alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    return calls, conversations.select("conv_id", result_id.alias("call_id"), "turn", F.col("text").alias("content"))
