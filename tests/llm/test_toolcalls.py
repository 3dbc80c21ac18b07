import json
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import toolcalls as tc
from tidelog.llm.queries import ORACLE_SQL, QUERIES

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def linked(spark, calls, results):
    out = tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return {(r["conv_id"], r["call_id"]): r for r in out if not r["status"].startswith("repeated")}, out


def test_links_and_errors(spark):
    calls = [
        (1, "a", 0, "f", '{"x": 1}', []), (1, "b", 2, "f", '{"x": -1, "y": 2}', ["a", "gone"]), (1, "c", 4, "g", "{}", None), (1, "d", 6, "f", "{broken", ["c"]), (1, "a", 9, "f", '{"x": 5}', []),
        (2, "a", 0, "f", None, []), (None, "a", 0, "f", '{"x":2}', []), (3, None, 0, "f", '{"x":2}', []), (3, "n", None, None, '{"x":1,"x":2}', []),
    ]
    by, out = linked(spark, calls, [(1, "a", 1, "one"), (1, "a", 1, "zzz"), (1, "q", 3, "lost"), (None, "a", 1, None), (3, None, 1, "loose"), (1, "b", 0, "early")])
    assert by[1, "a"]["status"] == "linked" and by[1, "a"]["n_calls"] == 2 and by[1, "a"]["n_results"] == 2
    assert by[1, "a"]["json"] == '{"arguments":{"x":1},"id":"a","name":"f","result":"one"}' and by[1, "a"]["valid"]
    assert by[1, "b"]["errors"] == ["$.x: minimum", "$.y: additional"] and by[1, "b"]["n_dangling"] == 1 and by[1, "b"]["status"] == "linked"
    assert by[1, "c"]["errors"] == ["unknown tool"] and by[1, "c"]["status"] == "unanswered"
    assert by[1, "d"]["errors"] == ["broken JSON"] and by[2, "a"]["errors"] == ["broken JSON"] and by[3, "n"]["errors"]
    assert by[1, "q"]["status"] == "orphan_result" and not by[1, "q"]["valid"]
    assert by[None, "a"]["status"] == "linked"
    assert sorted(r["n_calls"] for r in out if r["status"] == "no_identifier") == [0, 1]
    assert [by[1, x]["topo"] for x in "abcd"] == [0, 1, 2, 3]
    again = sorted((r["status"], r["call_id"], r["n_calls"], r["n_results"], r["json"]) for r in out if r["status"].startswith("repeated"))
    assert again == [("repeated_call", "a", 1, 0, '{"arguments":{"x":5},"id":"a","name":"f"}'), ("repeated_result", "a", 0, 1, '{"id":"a","result":"zzz"}')]


def test_equal_rows_are_counted_and_very_long_ones_kept(spark):
    calls = spark.createDataFrame([(1, "a", 0, "f", '{"x": 1}', [])] * 3, CALLS).withColumns({"CONTENT": F.lit(1), "Json": F.lit("x"), "c": F.lit(0)})
    results = spark.createDataFrame([(1, "a", 1, "y" * 3_000_000)] * 2, RESULTS).withColumns({"name": F.lit(5), "topo": F.lit(None)})
    (row,) = tc.link(calls, results, SCHEMAS).collect()
    assert (row["n_calls"], row["n_results"], row["status"], len(row["json"])) == (3, 2, "linked", 3_000_000 + len('{"arguments":{"x":1},"id":"a","name":"f","result":""}'))


def test_surrogates_and_schemas(spark):
    by, _ = linked(spark, [(1, "a", 0, "f", '{"x": 1, "y": "\\ud800"}', []), (1, "b", 1, "f", '{"x": 1.0}', [])], [])
    assert by[1, "a"]["errors"] == ["broken JSON"] and by[1, "b"]["valid"]
    v = tc.violations
    assert v(True, {"enum": [1]}) == ["$: enum"] and v(True, {"const": 1}) == ["$: const"] and v(1.0, {"const": 1, "type": "integer"}) == [] and v([1, {"a": True}], {"const": [1.0, {"a": 1}]}) == ["$: const"]
    assert v(1, {"type": "int"}) == ["$: unsupported type int"] and v(1, {"if": {}, "title": "t"}) == ["$: unsupported if"]
    assert v(5, {"exclusiveMinimum": 5, "exclusiveMaximum": 5, "multipleOf": 2}) == ["$: exclusiveMinimum", "$: exclusiveMaximum", "$: multipleOf"]
    assert v("ab", {"pattern": "^b"}) == ["$: pattern"] and v([1, 1.0], {"uniqueItems": True, "minItems": 3}) == ["$: minItems", "$: uniqueItems"]
    assert v(3, {"anyOf": [{"type": "string"}, {"minimum": 4}], "oneOf": [{}, {}], "not": {}, "allOf": [{"maximum": 2}, False]}) == ["$: anyOf", "$: oneOf", "$: not", "$: maximum", "$: false"]
    assert v({}, {"minProperties": 1}) == ["$: minProperties"] and v({"a": 1}, {"additionalProperties": {"type": "string"}}) == ["$.a: type"]


def test_empty(spark):
    assert linked(spark, [], [])[1] == []


def plain_order(calls):
    """Repeatedly the earliest call whose known dependencies, but for those on its own cycle, are out; and the calls on cycles."""
    names = [c for c, _ in calls]
    deps = {c: {d for d in own if d in names} for c, own in calls}
    reach = {c: set(d) for c, d in deps.items()}
    for _ in names:
        reach = {c: r | {x for d in r for x in reach[d]} for c, r in reach.items()}
    left = {c: {d for d in own if c not in reach[d] and d != c} for c, own in deps.items()}
    out = {}
    while len(out) < len(names):
        c = next(c for c in names if c not in out and left[c] <= out.keys())
        out[c] = len(out)
    return out, {c for c in names if c in reach[c]}


def test_order_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tc, "SPAN", 5)
    monkeypatch.setattr(tc, "TURNS", 4)
    rng = random.Random(3)
    calls, expected, cycles = [], {}, set()
    for conv in range(60):
        n = rng.randint(1, 22)
        ids = [f"c{i:02}" for i in range(n)]
        own = [(c, [rng.choice(ids + ["?"]) for _ in range(rng.choice([0, 0, 1, 2]))]) for c in ids]
        if conv % 3:  # mostly backwards, some forwards
            own = [(c, [d for d in deps if d == "?" or d < c or rng.random() < 0.25]) for c, deps in own]
        calls += [(conv or None, c, i, "f", '{"x":1}', deps) for i, (c, deps) in enumerate(own)]
        order, cyclic = plain_order(own)
        expected |= {(conv or None, c): order[c] for c, _ in own}
        cycles |= {(conv or None, c) for c in cyclic}
    by, _ = linked(spark, calls, [])
    assert {k: r["topo"] for k, r in by.items()} == expected
    assert {k for k, r in by.items() if r["status"] == "cycle"} == cycles and len(cycles) > 20
    # what stands behind a cycle has its place
    by, _ = linked(spark, [(1, "a", 0, "f", "{}", ["b"]), (1, "b", 1, "f", "{}", ["a"]), (1, "c", 2, "f", "{}", ["a"]), (1, "d", 3, "f", "{}", ["c"])], [])
    assert [by[1, x]["topo"] for x in "abcd"] == [0, 1, 2, 3] and [by[1, x]["status"] for x in "abcd"] == ["cycle", "cycle", "unanswered", "unanswered"]


def test_long_conversation_is_numbered_in_parts(spark):
    n = 3 * tc.TURNS + 5
    by, _ = linked(spark, [(1, f"c{i}", i, "f", '{"x":1}', [f"c{i - 1}"] if i else []) for i in range(n)], [])
    assert all(by[1, f"c{i}"]["topo"] == i for i in range(n))


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_canonical_round_trip(value):
    text = tc.canonical(value)
    assert tc.parse(text) == value and tc.canonical(tc.parse(text)) == text
    assert tc.parse(json.dumps(value, indent=2)) == value


def test_query_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        at = f"/root/testdata/{sf}"
        c = duckdb.connect()
        c.execute(f"create view conversations as select * from '{at}/conversations.parquet'")
        cursor = c.execute(ORACLE_SQL["op1_tool_calls"])
        names = [d[0] for d in cursor.description]
        got = QUERIES["op1_tool_calls"](spark, at)
        assert sorted(got.columns) == sorted(names)
        assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
    rows = got.collect()
    assert {r["status"] for r in rows} == {"linked", "unanswered", "orphan_result", "no_identifier", "cycle", "repeated_call", "repeated_result"}
    assert len({r["errors"] for r in rows}) >= 5 and sum(r["n_dangling"] for r in rows) > 10
    # the order is not that of the turns
    calls = [r for r in rows if r["topo"] is not None]
    plain = {}
    for r in sorted(calls, key=lambda r: (r["conv_id"], r["turn"], r["call_id"])):
        plain.setdefault(r["conv_id"], []).append(r["call_id"])
    assert sum(plain[r["conv_id"]].index(r["call_id"]) != r["topo"] for r in calls) > 0.1 * len(calls)
