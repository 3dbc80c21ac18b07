import json
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import catalog
from tidelog.operators import apply, changelog, encode
from tidelog.operators.route import route_mixed, route_table
from tidelog.operators.transform import apply_rule, compile_rule, project, snapshot_table
from tidelog.plans.schema import Column, SchemaError, Table
from tidelog.plans.selector import ConfigError, Route, compile_pattern

IMAGE = "struct<id:bigint,name:string,city:string,amount:decimal(10,2)>"
LOG = f"op string, before {IMAGE}, after {IMAGE}, seq long, source_ts_ms long, source_db string, source_table string"


def log_of(spark, *events):
    return spark.createDataFrame([(op, b, a, i if len(rest) == 0 else rest[0], 1000, "db", "t") for i, (op, b, a, *rest) in enumerate(events)], LOG)


A, B, C = (1, "alice", "hz", None), (2, "bob", "sh", None), (3, "ann", None, None)


def moved(row, city):
    return (row[0], row[1], city, row[3])


def test_op_rewrite_table(spark):
    log = log_of(
        spark, ("r", None, A), ("r", None, B), ("c", None, C), ("d", A, None), ("d", B, None), ("u", A, moved(A, "hz")), ("u", A, moved(A, "bj")), ("u", B, moved(B, "hz")), ("u", B, moved(B, "bj")), ("u", C, moved(C, "hz"))
    )
    out = apply_rule(log, compile_rule(r"db\.t", "id, CITY", "city = 'hz'")).orderBy("seq").collect()
    got = [(r["seq"], r["op"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in out]
    assert got == [(0, "r", None, (1, "hz")), (3, "d", (1, "hz"), None), (5, "u", (1, "hz"), (1, "hz")), (6, "d", (1, "hz"), None), (7, "c", None, (2, "hz")), (9, "c", None, (3, "hz"))]
    assert out[0]["after"].__fields__ == ["id", "CITY"]


def test_projection_rules(spark):
    log = log_of(spark, ("r", None, A))
    assert apply_rule(log, None) is log and project(log, ()) is log
    with pytest.raises(SchemaError):
        project(log, ("nope",))
    with pytest.raises(ConfigError):
        compile_rule("x", "*, id")
    assert compile_rule("x", "*").columns == ()
    rows = spark.createDataFrame([A, B, C], "id long, name string, city string, amount decimal(10,2)")
    out = snapshot_table(rows, compile_rule("x", "ID", "city IS NULL"))
    assert out.columns == ["ID"] and out.collect()[0][0] == 3
    with pytest.raises(SchemaError):
        snapshot_table(rows, compile_rule("x", "zzz"))


def test_routes(spark):
    log = log_of(spark, ("r", None, A))
    routes = [Route(compile_pattern("r", r"db\.t"), "x.y"), Route(compile_pattern("r", r"db\..*"), "x.all_<>", "<>")]
    assert {tuple(r) for r in route_table(log, routes, "db", "t").select("sink_db", "sink_table", "routed").collect()} == {("x", "y", True), ("x", "all_t", True)}
    assert [tuple(r) for r in route_table(log, [], "db", "t").select("sink_db", "sink_table", "routed").collect()] == [("db", "t", False)]
    mixed = spark.createDataFrame([("db", "t"), ("db", "u"), ("o", "v")], "source_db string, source_table string")
    got = {tuple(r) for r in route_mixed(mixed, routes, [("db", "t"), ("db", "u"), ("o", "v")], first_only=True).collect()}
    assert got == {("db", "t", "x", "y", True), ("db", "u", "x", "all_u", True), ("o", "v", "o", "v", False)}
    assert route_mixed(mixed, [], []).where("routed").count() == 0


# --- current state -----------------------------------------------------------------------------


def fold(events):
    state = {}
    for op, before, after in events:
        if op == "d" or (op == "u" and before[0] != after[0]):
            state.pop(before[0], None)
        if op != "d":
            state[after[0]] = after
    return sorted(state.values())


event = st.tuples(st.sampled_from("crud"), st.integers(1, 4), st.integers(1, 4), st.integers(0, 99))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(event, max_size=25), st.integers(0, 25))
def test_current_state_is_the_fold(spark, raw, cut):
    row = lambda k, v: (k, str(v), None, None)
    events = [(op, row(a, v) if op in "ud" else None, None if op == "d" else row(b, v)) for op, a, b, v in raw]
    # a log in any order of rows; seq is what counts
    rows = [(op, x, y, i, None, "db", "t") for i, (op, x, y) in enumerate(events, 1)]
    random.Random(len(raw)).shuffle(rows)
    log = spark.createDataFrame(rows, LOG)
    assert sorted(tuple(r) for r in apply.current_state(log, ("id",)).collect()) == fold(events)
    first, second = log.where(F.col("seq") <= cut), log.where(F.col("seq") > cut)
    merged = apply.merge_state(apply.current_state(first, ("id",)), second, ("id",))
    assert sorted(tuple(r) for r in merged.collect()) == fold(events)


def test_keys(spark):
    log = log_of(spark, ("c", None, A), ("u", A, moved(A, "x")), ("c", None, (None, "n", None, None)))
    assert apply.null_keys(log, ("id",)).count() == 1
    with pytest.raises(Exception, match="a key is null"):
        apply.current_state(log, ("id",)).collect()
    assert apply.current_state(log.where("seq < 2"), ()).count() == 2
    with pytest.raises(Exception, match="no key for delete"):
        apply.current_state(log_of(spark, ("d", A, None)), ()).collect()
    both = apply.current_state(log_of(spark, ("c", None, (1, "a", None, None)), ("c", None, (1, "b", None, None)), ("d", (1, "a", None, None), None)), ("id", "name"))
    assert [tuple(r)[:2] for r in both.collect()] == [(1, "b")]


def test_plan_combines_before_the_shuffle(spark):
    plan = apply.current_state(log_of(spark, ("c", None, A)), ("id",))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan and "Python" not in plan


def test_load_violations(spark):
    log = log_of(spark, ("r", None, A), ("d", A, None), ("u", A, (9, "x", None, None)), ("u", A, moved(A, "q")), ("c", None, (None, "x", None, None)), ("u", A, None))
    got = {r["seq"]: r["reason"] for r in apply.doris_violations(log, ("id",), ("id", "name", "city", "amount")).collect()}
    assert got == {1: "delete is not supported", 2: "key changed", 4: "key is missing or null", 5: "no after image"}
    assert apply.doris_violations(log.where("seq = 0"), ("id",), ("id",)).first()["reason"] == "unknown column amount"
    assert apply.doris_violations(log.where("seq = 0"), (), ("id",)).first()["reason"] == "no key"


# --- encoders ---------------------------------------------------------------------------------------


def test_envelope(spark):
    log = log_of(spark, ("r", A, A), ("u", A, moved(A, '<&"é>')), ("d", A, A))
    got = [json.loads(r["value"]) for r in encode.envelope(log, 99).orderBy("seq").collect()]
    assert got[0] == {"before": None, "after": {"amount": None, "city": "hz", "id": 1, "name": "alice"}, "source": {"version": "1", "connector": "mysql", "name": "mysql_binlog_source", "ts_ms": 1000, "db": "db", "table": "t"}, "op": "r", "ts_ms": 99}
    assert got[1]["before"]["id"] == 1 and got[1]["after"]["city"] == '<&"é>' and got[2]["after"] is None
    with pytest.raises(Exception, match="unknown op"):
        encode.envelope(log.withColumn("op", F.lit("q")), 1).collect()
    statements = spark.createDataFrame([("db", "t", 0, "DROP TABLE t")], "source_db string, source_table string, source_ts_ms long, ddl string")
    got = json.loads(encode.ddl_envelope(statements, 5).first()["value"])
    assert got["ddl"] == "DROP TABLE t" and got["before"] is None and got["source"]["ts_ms"] is None


def test_big_numbers_keep_their_digits(spark):
    log = spark.createDataFrame([("c", None, (Decimal(18446744073709551615),), 1, 0, "d", "t")], "op string, before struct<n:decimal(20,0)>, after struct<n:decimal(20,0)>, seq long, source_ts_ms long, source_db string, source_table string")
    assert '"n":18446744073709551615' in encode.envelope(log, 1).first()["value"]


def test_keys_and_topics(spark):
    log = route_table(log_of(spark, ("c", None, (7, 'a"\\\n}é', None, None)), ("d", A, None), ("c", None, (None, None, None, None))), [], "db", "t")
    keys = [r[0] for r in log.orderBy("seq").select(encode.message_key(log, ("name", "id"))).collect()]
    assert [json.loads(k) for k in keys] == [['a"\\\n}é', 7], ["alice", 1], ["", ""]]
    assert log.select(encode.message_key(log, ())).first()[0] is None
    assert log.select(encode.topic("all")).first()[0] == "all"
    assert log.withColumn("sink_table", F.lit("z")).select(encode.topic("all")).first()[0] == "db.z"
    with pytest.raises(ValueError):
        encode.topic("a b")


def own_table():
    return Table("db", "t", (Column("id", "bigint", False), Column("name", "varchar(9)"), Column("city", "varchar(9)"), Column("amount", "decimal(10,2)")), ("id",))


def test_documents(spark):
    import hashlib

    log = log_of(spark, ("r", None, A), ("u", A, (5, "x", None, None)), ("d", B, None))
    ops = encode.elastic_operations(log, own_table(), "db.t").orderBy("seq", "sub_seq").collect()
    part = lambda t: len(t).to_bytes(4, "big") + t.encode()
    doc_id = lambda k: hashlib.sha256(part("db.t") + part("id") + part(str(k))).hexdigest()
    assert [(o["action"], o["id"]) for o in ops] == [("index", doc_id(1)), ("delete", doc_id(1)), ("index", doc_id(5)), ("delete", doc_id(2))]
    assert json.loads(ops[0]["document"]) == {"id": 1, "name": "alice", "city": "hz", "amount": None}
    assert [o["action"] for o in encode.elastic_operations(log, own_table(), "i", delete_old_key=False).orderBy("seq").collect()] == ["index", "index", "delete"]
    last = encode.last_operations(encode.elastic_operations(log, own_table(), "i"))
    assert {r["id"]: r["action"] for r in last.collect()} == {doc_id(1): "delete", doc_id(5): "index", doc_id(2): "delete"}
    lines = [r["lines"] for r in encode.bulk_lines(encode.elastic_operations(log, own_table(), "i")).collect()]
    assert json.loads(lines[0].split("\n")[0]) == {"index": {"_index": "i", "_id": doc_id(1)}}
    assert encode.split_bulk(["ab\n", "c\n", "dd\n"], 5) == ["ab\nc\n", "dd\n"]
    with pytest.raises(ValueError):
        encode.split_bulk(["abcdef"], 3)
    with pytest.raises(SchemaError):
        encode.document_id(Table("d", "t"), "after", T.StructType())
    assert [encode.bulk_item(*x) for x in (("index", 201), ("delete", 404), ("index", 404), ("index", 429), ("index", 400))] == ["ok", "ok", "fail", "retry", "fail"]


def test_typed_documents(spark):
    own = Table("d", "t", (Column("id", "bigint unsigned", False), Column("at", "timestamp(6)"), Column("kind", "enum('a','b')"), Column("flags", "set('x','y')"), Column("j", "json"), Column("b", "varbinary(9)"), Column("y", "year"), Column("t", "time(3)")), ("id",))
    row = (Decimal(18446744073709551615), "2024-03-15 13:45:30.5", 2, 3, '{ "k" : [1, 2.50] }', b"\xde\xad", 99, "-1:02:03.5")
    kind = "struct<id:decimal(20,0),at:string,kind:bigint,flags:bigint,j:string,b:binary,y:smallint,t:string>"
    log = spark.createDataFrame([("c", None, row, 1)], f"op string, before {kind}, after {kind}, seq long")
    got = json.loads(log.select(encode.document(own, "after", log.schema["after"].dataType, "Asia/Shanghai")).first()[0])
    assert got == {"id": 18446744073709551615, "at": "2024-03-15 05:45:30.500000", "kind": "b", "flags": "x,y", "j": {"k": [1, 2.5]}, "b": "3q0=", "y": "0099", "t": "-1:02:03.500000"}


def test_negative_unsigned_key(spark):
    log = log_of(spark, ("c", None, (-1, "x", None, None)))
    own = Table("db", "t", (Column("id", "bigint unsigned", False),), ("id",))
    with pytest.raises(Exception, match="negative: -1"):
        log.select(encode.document_id(own, "after", log.schema["after"].dataType)).collect()


def test_json_lines(spark):
    log = log_of(spark, ("c", None, A))
    assert json.loads(encode.json_lines(log, ("name", "id", "amount")).first()["value"]) == {"name": "alice", "id": 1, "amount": None}
    with pytest.raises(SchemaError):
        encode.json_lines(log, ("zzz",))
    with pytest.raises(Exception, match="no JSON"):
        encode.json_lines(log, ("id", "name"), ("name",)).collect()
    with pytest.raises(Exception, match="no after image"):
        encode.json_lines(log_of(spark, ("d", A, None)), ("id",)).collect()


def test_labels_and_outcomes():
    assert encode.load_label("d.t", "n", 3) == encode.load_label("d.t", "n", 3) != encode.load_label("d.u", "n", 3)
    ok = {"Status": "Success", "NumberTotalRows": 2, "NumberLoadedRows": 2}
    cases = [(ok, "success"), (ok | {"NumberFilteredRows": 1}, "fatal"), (ok | {"NumberTotalRows": 3}, "fatal"), (ok | {"NumberLoadedRows": 1}, "fatal"), (ok | {"Label": "other"}, "unknown"), (None, "unknown"), ({"Status": "Publish Timeout"}, "success"), ({"Status": "Fail"}, "fatal"), ({"Status": "?"}, "unknown")]
    cases += [({"Status": "Label Already Exists", "ExistingJobStatus": s}, o) for s, o in (("FINISHED", "success"), ("RUNNING", "label-exists"), ("CANCELLED", "fatal"), ("", "unknown"))]
    for answer, outcome in cases:
        assert encode.load_outcome(answer, "l", 2) == outcome, answer


def test_sql(spark):
    assert encode.upsert_sql("mysql", "d`b", "t", ("id", "n"), ("id",)) == "INSERT INTO `d``b`.`t` (`id`, `n`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `id`=VALUES(`id`), `n`=VALUES(`n`)"
    assert encode.upsert_sql("postgresql", "s", "t", ("id",), ("id",)) == 'INSERT INTO "s"."t" ("id") VALUES ($1) ON CONFLICT ("id") DO NOTHING'
    assert encode.upsert_sql("postgresql", "s", "t", ("id",), ()) == 'INSERT INTO "s"."t" ("id") VALUES ($1)'
    assert encode.delete_sql("mysql", "d", "t", ("a", "b")) == "DELETE FROM `d`.`t` WHERE `a`=? AND `b`=?"
    for call in (lambda: encode.delete_sql("mysql", "d", "t", ()), lambda: encode.upsert_sql("postgresql", "s", "t", ("a",), ("id",))):
        with pytest.raises(SchemaError):
            call()
    assert encode.target_of("d", "t", True) == ("d", "t") and encode.target_of("d", "t", False, "s") == ("s", "t")
    log = log_of(spark, ("u", A, (5, "x", None, None)), ("d", B, None))
    got = [(r["sql"].split()[0], list(r["args"])) for r in encode.sql_statements(log, "mysql", "d", "t", ("id",)).orderBy("seq", "sub_seq").collect()]
    assert got == [("DELETE", ["1"]), ("INSERT", ["5", "x", None, None]), ("DELETE", ["2"])]
    with pytest.raises(Exception, match="a key is null"):
        encode.sql_statements(log_of(spark, ("c", None, (None, "x", None, None))), "postgresql", "d", "t", ("id",)).collect()
    with pytest.raises(Exception, match="no key for delete"):
        encode.sql_statements(log, "mysql", "d", "t", ()).collect()
    assert encode.retryable("mysql", "") and encode.retryable("postgresql", "08006") and not encode.retryable("postgresql", "23505") and not encode.retryable("mysql", "", committing=True)


def test_read_changes(spark):
    text = [{"op": "u", "before": {"id": 1}, "after": {"id": 1, "name": "x"}, "seq": 4, "source": {"db": "d", "table": "t", "ts_ms": 0}}, {"op": "ddl", "seq": 5, "ddl": "DROP TABLE t", "source": {"db": "d", "table": "t", "ts_ms": 7}}]
    lines = spark.createDataFrame([(json.dumps(x),) for x in text], "value string")
    got = changelog.read_changes(lines, T.StructType.fromDDL("id long, name string")).orderBy("seq").collect()
    assert got[0]["source_ts_ms"] is None and got[0]["before"]["id"] == 1 and got[1]["ddl"] == "DROP TABLE t" and got[1]["source_ts_ms"] == 7


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    """Composite keys: tasks follow the number of rows, the table is scanned once, all events of a row are made in one place."""
    rows = spark.range(400).select(F.floor(F.col("id") / 4).alias("l_orderkey"), F.lit(7).cast("long").alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.col("id").cast("double").alias("l_quantity"))
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    assert catalog.tasks_of(rows, 10) == 40 and catalog.tasks_of(rows) == spark.sparkContext.defaultParallelism
    log = catalog.lineitem_log(rows.dropDuplicates(keys))
    dealt = apply.current_state(log, keys, 40)
    assert dealt.rdd.getNumPartitions() == 40 and sorted(dealt.collect()) == sorted(apply.current_state(log, keys).collect())
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.composite_key_apply(spark, str(tmp_path))
    # of the rows of a key, which have equal order and supplier, the larger quantity is that of the later row
    expected = [(k, 7, s, 1, float(4 * k + s + 2 + (k % 3 == 0))) for k in range(100) for s in range(2) if k % 4]
    assert sorted(tuple(r) for r in found.collect()) == expected
    plan = catalog.composite_key_apply(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2
    log = catalog.lineitem_log(rows.where("l_orderkey = 12"))
    assert sorted(tuple(r) for r in log.select("op", "seq").distinct().collect()) == [("d", 2), ("r", 0), ("u", 1)]
