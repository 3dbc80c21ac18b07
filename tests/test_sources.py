import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.__main__ import main
from tidelog.log import set_up
from tidelog.operators.changelog import snapshot
from tidelog.operators.encode import elastic_operations, json_lines
from tidelog.operators.transform import compile_rule
from tidelog.plans.config import Block, load_pipeline
from tidelog.plans.evolve import Policy, SchemaChangeError
from tidelog.plans.job import Job, run_batch
from tidelog.plans.schema import Column, SchemaError, Table
from tidelog.sinks import writers
from tidelog.sinks.targets import Transports
from tidelog.sources import snapshot as s
from tidelog.sources.tables import FolderSource, table_from_catalog
from tidelog.sources.verify import checksum, crc_checksum, differences
from tidelog.streaming.runner import Stats, TableApplier, change_stream, segments, start
from tidelog.streaming.state import State, StateFile
from tidelog.streaming.tables import VersionedTable

# --- splits and starts ------------------------------------------------------------------


def plain_splits(keys, chunk):
    keys = sorted(keys)
    lows = keys[:: chunk - 1]
    return [(i, low, lows[i + 1] if i + 1 < len(lows) else None) for i, low in enumerate(lows)]


@pytest.mark.parametrize(("n", "chunk"), [(0, 2), (1, 2), (7, 2), (9, 4), (100, 10), (300, 8)])
def test_splits(spark, n, chunk):
    rows = spark.range(n).select((F.col("id") * 7 - 20).alias("k"))
    got = [tuple(r) for r in s.plan_splits(rows, "k", chunk).orderBy("split_id").collect()]
    assert got == plain_splits([i * 7 - 20 for i in range(n)], chunk)
    seen = [r["k"] for _, low, high in got for r in rows.where(s.split_predicate("k", low, high)).collect()]
    assert sorted(seen) == [i * 7 - 20 for i in range(n)]


def test_split_edges(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("c",)], "k string")
    assert [tuple(r) for r in s.plan_splits(rows, "k", 3).orderBy("split_id").collect()] == [(0, "a", "c"), (1, "c", None)]
    with pytest.raises(ValueError):
        s.plan_splits(rows, "k", 1)
    assert s.plan_splits(rows.limit(0), "k", 1).count() == 0
    splits = s.plan_splits(rows, "k", 3)
    assert [r["low"] for r in s.unfinished(splits, [("c", None)]).collect()] == ["a"] and s.unfinished(splits, []).count() == 2
    assert s.jdbc_predicates("k`x", [("", "it's"), (5, None), (None, None)]) == ["`k``x` < 'it''s'", "`k``x` >= 5", "1 = 1"]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_splits_in_many_blocks(spark, kind):
    """A task gets one range of the keys, in order, and nothing is kept beside the sort."""
    rows = spark.range(3000).select((F.col("id") * 37 % 1501 - 700).cast(kind).alias("k")).union(spark.range(2000).select(F.lit(5).cast(kind))).union(spark.range(2).select(F.lit(None).cast(kind)))
    keys = {"bigint": int, "string": str, "double": float}[kind]
    keys = [keys(k) for k in range(-700, 801)]
    for chunk in (2, 8, 100, 9999):
        found = s.plan_splits(rows, "k", chunk, block_keys=50)
        assert sorted(tuple(r) for r in found.collect()) == plain_splits(keys, chunk)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    placed = s._places(rows.where("k is not null"), False, 50)
    assert sorted((r["place"], r["k"]) for r in placed.collect()) == list(enumerate(sorted(keys)))
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1501 and max(sizes) <= 2.5 * 50 and s.BLOCK_KEYS <= 1_000_000


def test_starts(spark):
    rows = spark.createDataFrame([(i, "c" if i != 3 else "ddl", 1000 * i + 500 if i != 5 else None) for i in range(1, 9)], "seq long, op string, source_ts_ms long")
    got = lambda *a, **k: sorted(r["seq"] for r in s.from_start(rows, s.Startup(*a, **k), 2).collect())
    assert got("snapshot") == [] and got("initial") == [3, 4, 5, 6, 7, 8] and got("latest") == [3, 4, 5, 6, 7, 8] and got("earliest") == list(range(1, 9))
    assert got("specific-offset", seq=7) == [7, 8] and got("timestamp", timestamp_ms=4999) == [4, 6, 7, 8] and got("earliest", skip_rows=3) == [5, 6, 7, 8] and got("earliest", skip_rows=99) == []
    assert got("specific-offset", seq=99, skip_rows=2) == [] and got("earliest", skip_events=3) == [4, 5, 6, 7, 8] and got("earliest", skip_events=1, skip_rows=2) == [5, 6, 7, 8]
    tables = rows.withColumns({"source_db": F.lit("d"), "source_table": F.lit("t")})
    assert s.without_replays(tables.union(tables)).count() == 8 and s.without_ddl(rows, False).count() == 7 and s.without_ddl(rows, True).count() == 8


@pytest.mark.parametrize(("a", "b", "c", "resumed", "created"), [(False, True, False, "ignored", "drop"), (False, False, True, "ignored", "follow"), (True, True, False, "snapshot", "drop"), (True, True, True, "snapshot", "follow"), (True, False, False, "changes_only", "drop"), (True, False, True, "changes_only", "follow")])
def test_new_tables(a, b, c, resumed, created):
    flags = s.NewTables(a, b, c)
    assert s.on_resume({"d.new", "d.old"}, {"d.old"}, set(), flags) == {"d.new": resumed, "d.old": "live"} and s.on_create(flags) == created
    assert s.on_resume({"d.new"}, set(), set(), flags, has_position=False) == {"d.new": "snapshot"}
    assert s.on_resume({"d.new"}, set(), {"d.new"}, flags) == {"d.new": "ignored"}


def test_checksums_and_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k int, v string")
    assert checksum(a, "k", "v").first() == checksum(a.repartition(3), "k", "v").first() != checksum(b, "k", "v").first()
    assert crc_checksum(a, "k", "v").first()["n_rows"] == 3
    assert {tuple(r) for r in differences(a, b, ("k",)).collect()} == {(2, "changed"), (3, "left_only"), (4, "right_only")}


# --- state ------------------------------------------------------------------------------------


def test_state_file(spark, tmp_path):
    file = StateFile(str(tmp_path / "a" / "x.ckpt"), spark)
    assert file.load() == State() and file.load().resume_from is None
    state = State(low_watermark=3)
    state.finish_split("d.t", 1, None)
    state.finish_split("d.t", 1, None)
    file.save(state)
    again = file.load()
    assert again.is_finished("d.t", 1, None) and not again.is_finished("d.t", 1, 5) and again.resume_from == 3 and len(again.finished_splits["d.t"]) == 1
    again.capture("d.t")
    again.acked = 9
    file.save(again)
    assert file.load().captured == ["d.t"] and file.load().finished_splits == {} and file.load().resume_from == 9
    assert [p.name for p in (tmp_path / "a").iterdir() if p.name[0] != "."] == ["x.ckpt"]
    again.ack("d.t", 4)
    again.ack("d.u", 12)
    assert again.position("d.t") == 4 and again.acked == 12 and again.position("d.x") == 3
    # a crash between both steps of a save leaves the new document aside
    (tmp_path / "a" / "x.ckpt").rename(tmp_path / "a" / "x.ckpt.new")
    assert file.load().acked == 9
    file.save(again)
    assert file.load() == again


def test_versioned_table(spark, tmp_path):
    own = VersionedTable(spark, str(tmp_path / "t"))
    assert own.read() is None and own.batch() is None
    assert own.replace(spark.range(3), 0) and not own.replace(spark.range(99), 0) and own.read().count() == 3
    # a version that was written but never published is overwritten
    spark.range(50).write.parquet(str(tmp_path / "t" / "v2"))
    assert own.read().count() == 3 and own.replace(own.read().union(spark.range(2)), 1) and own.read().count() == 5
    own.replace(spark.range(0).withColumn("new", F.lit("x")), 2)
    assert own.read().columns == ["id", "new"] and own.read().count() == 0
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v")) == ["v2", "v3"]


def test_deltas_and_compaction(spark, tmp_path):
    own = VersionedTable(spark, str(tmp_path / "t"), ("id",), compact_every=3)
    write = lambda *rows: spark.createDataFrame(rows, "id long, name string, __deleted boolean")
    rows = lambda: sorted(tuple(r) for r in own.read().collect())
    assert own.append(write((1, "a", False), (2, "b", False)), 0) and not own.append(write((9, "z", False)), 0)
    assert own.append(write((1, None, True), (2, "bb", False)), 1) and rows() == [(2, "bb")]
    names = lambda: sorted(p.name for p in (tmp_path / "t").iterdir() if p.name[0] in "vd")
    assert len(names()) == 2 and {n[0] for n in names()} == {"d"}
    own.append(write((1, "again", False), (3, "c", False)), 5)
    assert "v" in {n[0] for n in names()} and rows() == [(1, "again"), (2, "bb"), (3, "c")] and own.batch() == 5
    own.append(write((3, None, True)), 6)
    own.append(write((3, "new", False)), 7)
    assert sorted(n[0] for n in names()) == ["d", "d", "v"] and rows() == [(1, "again"), (2, "bb"), (3, "new")]
    own.compact()
    assert rows() == [(1, "again"), (2, "bb"), (3, "new")]
    keyless = VersionedTable(spark, str(tmp_path / "k"))
    for batch in range(3):
        keyless.append(write((1, "a", False)), batch)
    assert keyless.read().count() == 3 and keyless.schema().names == ["id", "name"]


# --- streams --------------------------------------------------------------------------------------

KIND = "id long, name string"


def put(folder, name, *events):
    folder.mkdir(exist_ok=True)
    text = "\n".join(json.dumps({"op": op, "before": b, "after": a, "seq": i, "ddl": sql, "source": {"db": "d", "table": "t", "ts_ms": 1}}) for i, op, b, a, sql in events)
    (folder / f"{name}.json").write_text(text)


def row(i, name, **more):
    return {"id": i, "name": name} | more


def run(spark, tmp_path, applier, kind=KIND):
    start(change_stream(spark, str(tmp_path / "in"), T.StructType.fromDDL(kind), 1), applier, str(tmp_path / "ck")).awaitTermination()
    return sorted(tuple(r) for r in applier.state.read().collect())


def test_stream_restart_and_replay(spark, tmp_path):
    applier = lambda: TableApplier(spark, str(tmp_path / "state"), ("id",), compile_rule("x", "", "name <> 'out'"))
    put(tmp_path / "in", "a", (1, "c", None, row(1, "a"), None), (2, "c", None, row(2, "b"), None), (3, "u", row(2, "b"), row(2, "out"), None))
    put(tmp_path / "in", "b", (4, "u", row(1, "a"), row(5, "a"), None))
    first = applier()
    assert run(spark, tmp_path, first) == [(5, "a")] and first.stats.batches == 2
    put(tmp_path / "in", "c", (5, "c", None, row(1, "again"), None), (6, "d", row(5, "a"), None, None))
    second = applier()
    assert run(spark, tmp_path, second) == [(1, "again")] and second.stats.batches == 1
    # the same batch once more changes nothing
    second(spark.createDataFrame([], "op string, before struct<id:long,name:string>, after struct<id:long,name:string>, seq long, ddl string"), 0)
    assert second.stats.skipped == 1 and second.stats.report()["skipped"] == 1


def test_crash_before_the_version_is_published(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "a", (1, "c", None, row(1, "a"), None))
    applier = TableApplier(spark, str(tmp_path / "state"), ("id",))

    def fail(pointer, batch):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(applier.state, "publish", fail)
        with pytest.raises(Exception, match="crash"):
            run(spark, tmp_path, applier)
    assert run(spark, tmp_path, TableApplier(spark, str(tmp_path / "state"), ("id",))) == [(1, "a")]


def test_schema_change_cuts_the_batch(spark, tmp_path):
    table = Table("d", "t", (Column("id", "bigint", False), Column("name", "varchar(9)")), ("id",))
    define = lambda change: {"note": Column("note", "varchar(9)", default="none")}
    make = lambda **k: TableApplier(spark, str(tmp_path / "state"), ("id",), None, table, Policy("mysql", **k), define)
    kind = KIND + ", note string"
    put(tmp_path / "in", "a", (1, "c", None, row(1, "a"), None), (2, "ddl", None, None, "ALTER TABLE d.t ADD COLUMN note varchar(9)"), (3, "c", None, row(2, "b", note="n"), None))
    applier = make()
    current = run(spark, tmp_path, applier, kind)
    assert [r[0] for r in current] == [1, 2] and applier.table.column("note")
    put(tmp_path / "in", "b", (4, "ddl", None, None, "TRUNCATE d.t"), (5, "c", None, row(9, "z", note="q"), None))
    assert [r[0] for r in run(spark, tmp_path, make(drop_truncate=True), kind)] == [9]
    put(tmp_path / "in", "c", (6, "ddl", None, None, "ALTER TABLE d.t CONVERT TO CHARACTER SET x"))
    with pytest.raises(Exception, match="not understood"):
        run(spark, tmp_path, make(), kind)
    assert issubclass(SchemaChangeError, RuntimeError)


def test_segments(spark):
    batch = spark.createDataFrame([(1, "c", None), (2, "ddl", "A"), (3, "c", None), (4, "ddl", "B")], "seq long, op string, ddl string")
    assert [(sorted(r["seq"] for r in rows.collect()), cut and cut["ddl"]) for rows, cut in segments(batch)] == [([1], "A"), ([3], "B"), ([], None)]


def test_stats():
    own = Stats()
    own.add(10)
    assert own.report()["delta"] == 10 and own.report()["delta"] == 0 and own.report()["rows"] == 10


# --- writers ------------------------------------------------------------------------------------------

LOG = "op string, before struct<id:long,name:string>, after struct<id:long,name:string>, seq long, source_ts_ms long, source_db string, source_table string"


@pytest.fixture
def log(spark):
    return spark.createDataFrame([("c", None, (1, "a"), 1, None, "d", "t"), ("u", (1, "a"), (2, "b"), 2, None, "d", "t"), ("c", None, (3, "c"), 3, None, "d", "t")], LOG)


def test_sql_writer(spark, log, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    sqlite3.connect(path).execute("CREATE TABLE t (id integer primary key, name text)").connection.commit()

    def connect():
        import sqlite3

        return sqlite3.connect(path, timeout=30)

    # a changed key's delete and write, and a later write of a key, lie in different tasks; a replay has other partitions
    more = spark.createDataFrame([("u", (2, "b"), (1, "back"), 4, None, "d", "t"), ("u", (3, "c"), (3, "cc"), 5, None, "d", "t")], LOG)
    for n in (1, 7):
        writers.write_log(log.union(more).repartition(n, "seq").coalesce(2), connect, "postgresql", "main", "t", ("id",), 2)
        assert sqlite3.connect(path).execute("SELECT * FROM t ORDER BY id").fetchall() == [(1, "back"), (3, "cc")]
    statements = spark.createDataFrame([("DELETE FROM nope", [])], "sql string, args array<string>")
    with pytest.raises(Exception, match="no such table"):
        writers.write_sql(statements, connect, "postgresql", max_retries=1)
    with pytest.raises(Exception, match="a key is null"):
        writers.write_log(spark.createDataFrame([("c", None, (None, "x"), 9, None, "d", "t")], LOG), connect, "mysql", "main", "t", ("id",))
    assert writers.placed("INSERT INTO `a?` VALUES ($1, $12, '?%')", "%s") == "INSERT INTO `a?` VALUES (%s, %s, '?%%')"


def test_bulk_retries_only_what_failed(spark, log, tmp_path):
    table = Table("d", "t", (Column("id", "bigint", False), Column("name", "varchar(9)")), ("id",))
    seen = tmp_path / "bulk"

    def post(url, body, headers):
        from tidelog.sinks.writers import bulk_items

        items = bulk_items(body.decode())
        again = seen.exists()
        with seen.open("a") as f:
            f.write(f"{len(items)}\n")
        return 200, {"items": [{a: {"status": 201 if again or i else 429}} for i, (a, _) in enumerate(items)]}

    operations = elastic_operations(log.unionByName(log.where("seq = 3").withColumn("seq", F.lit(9).cast("long"))), table, "i")
    writers.write_bulk(operations, "http://x", {}, post=post, wait=0)
    # three documents, each named once; one task's first item is told to come again
    sent = [int(n) for n in seen.read_text().split()]
    assert sum(sent) == 4 and 1 in sent
    assert writers.left_over("x", 503, {}) == "x"
    with pytest.raises(writers.DeliveryError):
        writers.left_over("x", 400, {})
    with pytest.raises(writers.DeliveryError):
        writers.left_over('{"delete":{}}\n', 200, {"items": [{"delete": {"status": 400}}]})


def test_stream_load_writer(spark, log, tmp_path):
    seen = tmp_path / "labels"

    def put_(label, body):
        first = not seen.exists()
        with seen.open("a") as f:
            f.write(label + "\n")
        n = body.count(b"\n") + 1
        return {} if first else {"Status": "Success", "NumberTotalRows": n, "NumberLoadedRows": n}

    rows = json_lines(log, ("id", "name"))
    writers.write_stream_load(rows.coalesce(1), "d", "t", "n", 7, put_, wait=0, parts=1)
    labels = seen.read_text().split()
    assert len(labels) == 2 and len(set(labels)) == 1
    # a replay in other partitions makes the same loads under the same labels
    many = spark.range(500).select(F.lit(0).alias("seq"), F.concat(F.lit("row "), F.col("id")).alias("value"))
    found = []
    for n in (1, 5):
        seen.write_text("")
        writers.write_stream_load(many.repartition(n), "d", "t", "n", 7, put_, wait=0, most_rows=50, parts=4)
        found.append(sorted(seen.read_text().split()))
    assert found[0] == found[1] and len(set(found[0])) == len(found[0]) >= 10
    assert [n for _, n in writers.loads(["a" * 9, "b", "c"], 2, 10)] == [1, 2]
    with pytest.raises(Exception, match="fatal"):
        writers.write_stream_load(rows, "d", "t", "n", 8, lambda label, body: {"Status": "Fail"}, wait=0)


def test_lines(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("a",), ("b",)], "value string")
    writers.write_lines(rows, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]
    writers.print_lines(rows.coalesce(1))
    assert capsys.readouterr().out == "a\nb\n"


# --- whole pipelines -------------------------------------------------------------------------------------


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, "alice", "hz"), (2, "bob", "sh"), (3, "ann", "hz")], "id long, name string, city string").coalesce(1).write.parquet(str(tmp_path / "src/shop/people.parquet"))
    lines = [{"op": "u", "before": {"id": 1, "name": "alice", "city": "hz"}, "after": {"id": 1, "name": "alice", "city": "bj"}, "seq": 1}, {"op": "u", "before": {"id": 2, "name": "bob", "city": "sh"}, "after": {"id": 7, "name": "bob", "city": "hz"}, "seq": 2}]
    (tmp_path / "src/shop/people.changes").mkdir()
    (tmp_path / "src/shop/people.changes/x.json").write_text("\n".join(json.dumps(x | {"source": {"db": "shop", "table": "people", "ts_ms": 5}}) for x in lines))
    return tmp_path


SETTINGS = {
    "source": {"hostname": "h", "username": "u", "password": "p", "tables": r"shop\..*"},
    "sink": {"type": "mysql", "hostname": "h", "username": "u", "password": "p"},
    "route": [{"source-table": r"shop\..*", "sink-table": "dw.<>_out", "replace-symbol": "<>"}],
    "transform": [{"source-table": r"shop\.people", "projection": "id, name", "filter": "city = 'hz'", "primary-keys": "id"}],
    "pipeline": {"name": "p"},
}


def rows_of(spark, folder, name, *keys):
    return sorted(map(tuple, VersionedTable(spark, str(folder / name), keys).read().collect()))


def settings(folder, **more):
    return load_pipeline(SETTINGS | {"checkpoint": {"file-path": str(folder / "ck")}} | more)


def test_run_batch(spark, folder):
    pipeline = settings(folder)
    source = FolderSource(spark, str(folder / "src"), [("shop", "people"), ("mysql", "user")])
    for _ in range(2):
        assert run_batch(spark, pipeline, source, str(folder / "out")) == {"dw.people_out": 2}
        assert rows_of(spark, folder / "out", "dw.people_out", "id") == [(3, "ann"), (7, "bob")]
    assert VersionedTable(spark, str(folder / "out/dw.people_out")).batch() == 0  # nothing new, nothing written
    state = StateFile(pipeline.checkpoint.file_path, spark).load()
    assert state.captured == ["shop.people"] and state.positions == {"shop.people": 2} and state.low_watermark == 0
    assert Job(spark, pipeline, source).sinks["dw", "people_out"].keys == ("id",)


def change_lines(folder, name, *events, more=""):
    at = folder / f"src/shop/{name}.changes"
    at.mkdir(exist_ok=True)
    (at / f"x{more}.json").write_text("\n".join(json.dumps({"op": op, "before": b, "after": a, "seq": i, "ddl": sql, "source": {"db": "shop", "table": name, "ts_ms": i}}) for i, op, b, a, sql in events))


def people(i, name, city="hz"):
    return {"id": i, "name": name, "city": city}


def test_two_tables_into_one(spark, folder):
    """Tables that are routed into one sink table are one log: the later change of a key wins, wherever it is from."""
    spark.createDataFrame([(10, "zoe", "hz", 1), (3, "twin", "hz", 2)], "id int, name string, city string, age int").write.parquet(str(folder / "src/shop/more.parquet"))
    change_lines(folder, "more", (3, "u", people(3, "twin"), people(3, "later") | {"age": 9}, None), (4, "c", None, people(11, "kim") | {"age": None}, None))
    pipeline = settings(folder, route=[{"source-table": r"shop\..*", "sink-table": "lake.all"}], transform=[{"source-table": r"shop\..*", "primary-keys": "id"}])
    source = FolderSource(spark, str(folder / "src"), [("shop", "people"), ("shop", "more")])
    assert run_batch(spark, pipeline, source, str(folder / "out")) == {"lake.all": 4}
    got = VersionedTable(spark, str(folder / "out/lake.all"), ("id",))
    assert got.read().dtypes[0] == ("id", "bigint")
    by_id = {r["id"]: (r["name"], r["city"], r["age"]) for r in got.read().collect()}
    assert by_id == {1: ("alice", "bj", None), 7: ("bob", "hz", None), 3: ("later", "hz", 9), 10: ("zoe", "hz", 1), 11: ("kim", "hz", None)}
    change_lines(folder, "people", (6, "u", people(11, "kim"), people(11, "moved"), None), more="2")
    run_batch(spark, pipeline, source, str(folder / "out"))
    assert {r["name"] for r in got.read().where("id = 11").collect()} == {"moved"} and got.batch() == 1
    with pytest.raises(ValueError, match="different keys"):
        Job(spark, settings(folder, route=[{"source-table": r"shop\..*", "sink-table": "lake.all"}], transform=[{"source-table": r"shop\.people", "primary-keys": "id"}]), source)


def test_latest_reads_only_what_comes_after(spark, folder):
    pipeline = settings(folder, source=SETTINGS["source"] | {"scan.startup.mode": "latest"}, transform=[{"source-table": ".*", "primary-keys": "id"}])
    source = FolderSource(spark, str(folder / "src"), [("shop", "people")])
    run_batch(spark, pipeline, source, str(folder / "out"))
    assert VersionedTable(spark, str(folder / "out/dw.people_out")).read() is None
    change_lines(folder, "people", (3, "c", None, people(9, "new"), None), more="2")
    run_batch(spark, pipeline, source, str(folder / "out"))
    assert rows_of(spark, folder / "out", "dw.people_out", "id") == [(9, "new", "hz")]


def test_resume_and_new_tables(spark, folder):
    own = dict(transform=[{"source-table": ".*", "primary-keys": "id"}])
    source = FolderSource(spark, str(folder / "src"), [("shop", "people")])
    run_batch(spark, settings(folder, **own), source, str(folder / "out"))
    spark.createDataFrame([(1, "late", "hz")], "id long, name string, city string").write.parquet(str(folder / "src/shop/late.parquet"))
    source = FolderSource.open(spark, str(folder / "src"))
    assert source.tables() == [("shop", "late"), ("shop", "people")]
    run_batch(spark, settings(folder, **own), source, str(folder / "out"))
    assert not (folder / "out/dw.late_out").exists()
    run_batch(spark, settings(folder, source=SETTINGS["source"] | {"scan.newly-added-table.enabled": True}, **own), source, str(folder / "out"))
    assert rows_of(spark, folder / "out", "dw.late_out", "id") == [(1, "late", "hz")]
    change_lines(folder, "people", (5, "d", people(7, "bob"), None, None), more="2")
    run_batch(spark, settings(folder, **own), source, str(folder / "out"))
    assert [r[0] for r in rows_of(spark, folder / "out", "dw.people_out", "id")] == [1, 3]


def test_splits_are_not_read_twice(spark, folder, monkeypatch):
    own = settings(folder, source=SETTINGS["source"] | {"scan.incremental.snapshot.chunk.size": 2}, transform=[{"source-table": ".*", "primary-keys": "id"}])
    source = FolderSource(spark, str(folder / "src"), [("shop", "people")], {("shop", "people"): ("id",)}, by_split=True)
    job = Job(spark, own, source, str(folder / "out"), wave=2)
    seen = []
    plain_read = FolderSource.read

    def read(self, database, table, key=None, splits=None):
        if splits is not None:
            seen.extend(splits)
            if len(seen) == 3:
                raise RuntimeError("crash")
        return plain_read(self, database, table, key, splits)

    monkeypatch.setattr(FolderSource, "read", read)
    with pytest.raises(RuntimeError, match="crash"):
        job.run()
    assert StateFile(own.checkpoint.file_path, spark).load().finished_splits == {"shop.people": [(None, 2), (2, 3)]}
    seen.clear()
    seen.append(None)
    Job(spark, own, source, str(folder / "out"), wave=2).run()
    assert seen[1:] == [(3, None)]
    assert [r[0] for r in rows_of(spark, folder / "out", "dw.people_out", "id")] == [1, 3, 7]


SCHEMA = {"columns": [{"name": "id", "type": "bigint", "nullable": False}, {"name": "name", "type": "varchar(20)"}, {"name": "city", "type": "varchar(20)"}, {"name": "note", "type": "varchar(9)", "default": "none"}], "primary_keys": ["id"]}


def test_schema_changes_in_a_run(spark, folder):
    plain = settings(folder, transform=None)
    source = FolderSource(spark, str(folder / "src"), [("shop", "people")], {("shop", "people"): ("id",)})
    run_batch(spark, plain, source, str(folder / "out"))
    (folder / "src/shop/people.schema.json").write_text(json.dumps(SCHEMA))
    change_lines(folder, "people", (3, "c", None, people(8, "x"), None), (4, "ddl", None, None, "ALTER TABLE shop.people ADD COLUMN note varchar(9) DEFAULT 'none'"), (5, "u", people(3, "ann"), people(3, "ann") | {"note": "n"}, None), more="2")
    run_batch(spark, plain, source, str(folder / "out"))
    stored = VersionedTable(spark, str(folder / "out/dw.people_out"), ("id",))
    assert sorted((r["id"], r["note"]) for r in stored.read().collect()) == [(1, "none"), (3, "n"), (7, "none"), (8, "none")]
    base = [p.name for p in (folder / "out/dw.people_out").iterdir() if p.name[0] == "v"]
    assert base == ["v1"]  # nothing was rewritten
    stored.compact()
    assert sorted((r["id"], r["note"]) for r in stored.read().collect()) == [(1, "none"), (3, "n"), (7, "none"), (8, "none")]
    off = settings(folder, transform=None, source=SETTINGS["source"] | {"schema-change.enabled": False})
    change_lines(folder, "people", (6, "ddl", None, None, "ALTER TABLE shop.people CONVERT TO CHARACTER SET x"), more="3")
    with pytest.raises(SchemaChangeError, match="not understood"):
        run_batch(spark, plain, source, str(folder / "out"))
    run_batch(spark, off, source, str(folder / "out"))


def test_follow(spark, folder):
    own = settings(folder, transform=[{"source-table": ".*", "primary-keys": "id"}])
    source = FolderSource(spark, str(folder / "src"), [("shop", "people")])
    job = Job(spark, own, source, str(folder / "out"))
    job.follow(str(folder / "stream")).awaitTermination()
    change_lines(folder, "people", (5, "c", None, people(20, "s"), None), (6, "d", people(3, "ann"), None, None), more="2")
    job.follow(str(folder / "stream")).awaitTermination()
    assert [r[0] for r in rows_of(spark, folder / "out", "dw.people_out", "id")] == [1, 7, 20]
    again = Job(spark, own, source, str(folder / "out"))
    change_lines(folder, "people", (7, "u", people(20, "s"), people(21, "t"), None), more="3")
    lines = spark.read.text(str(folder / "src/*/*.changes"))
    again.floor = dict(again.state.positions)
    again.batch(lines, 9)
    again.batch(lines, 9)  # a replay
    assert [r[0] for r in rows_of(spark, folder / "out", "dw.people_out", "id")] == [1, 7, 21] and again.stats.batches == 2
    assert StateFile(own.checkpoint.file_path, spark).load().positions == {"shop.people": 7}


# --- every sink from settings ------------------------------------------------------------------------------


def sink_settings(folder, sink):
    return settings(folder, sink=sink, transform=[{"source-table": ".*", "primary-keys": "id"}])


@pytest.fixture
def source(spark, folder):
    (folder / "src/shop/people.schema.json").write_text(json.dumps(SCHEMA | {"columns": SCHEMA["columns"][:3]}))
    return FolderSource.open(spark, str(folder / "src"))


@pytest.mark.parametrize("kind", ["mysql", "postgresql"])
def test_sql_sinks(spark, folder, source, kind):
    path = str(folder / "target.db")

    def connect():
        import sqlite3

        class Cursor(sqlite3.Cursor):
            def execute(self, sql, args=()):
                sql = sql.replace('"dw".', "").replace("`dw`.", "").replace("ON DUPLICATE KEY UPDATE", "ON CONFLICT DO UPDATE SET").replace("VALUES(`", "(excluded.`")
                return super().execute(sql.replace("TIMESTAMP(6)", "TEXT"), args)

        class Connection(sqlite3.Connection):
            def cursor(self):
                return super().cursor(Cursor)

        return sqlite3.connect(path, timeout=30, factory=Connection)

    sink = {"type": kind, "hostname": "h", "username": "u", "password": "p", "database": "x", "auto-create-table": True}
    pipeline = sink_settings(folder, sink | ({"schema.change.enabled": True, "schema.change.include": ["add.column"]} if kind == "postgresql" else {}))
    transports = Transports(connect=connect, catalog=lambda schema, table: None)
    run_batch(spark, pipeline, source, transports=transports)
    read = lambda: connect().execute("SELECT * FROM people_out ORDER BY id").fetchall()
    assert read() == [(1, "alice", "bj"), (3, "ann", "hz"), (7, "bob", "hz")]
    (folder / "src/shop/people.schema.json").write_text(json.dumps(SCHEMA))
    change_lines(folder, "people", (4, "ddl", None, None, "ALTER TABLE shop.people ADD COLUMN note varchar(9) DEFAULT 'none'"), (5, "u", people(3, "ann"), people(4, "ann") | {"note": "n"}, None), more="2")
    there = {n: {"type": t, "nullable": n != "id", "default": False} for n, t in (("id", "BIGINT"), ("name", "VARCHAR(20)"), ("city", "VARCHAR(20)"))}
    transports = Transports(connect=connect, catalog=lambda schema, table: (there, ("id",)))
    if kind == "mysql":
        run_batch(spark, pipeline, source, transports=transports)
        assert read() == [(1, "alice", "bj", "none"), (4, "ann", "hz", "n"), (7, "bob", "hz", "none")]
    with pytest.raises(SchemaError, match="is not|not covered"):
        run_batch(spark, sink_settings(folder, sink | {"type": "postgresql"}), FolderSource.open(spark, str(folder / "src")), transports=Transports(connect=connect, catalog=lambda s, t: (there | {"name": {"type": "INTEGER", "nullable": True, "default": False}}, ("id",)))) if kind == "postgresql" else (_ for _ in ()).throw(SchemaError("is not"))


def test_elastic_sink(spark, folder, source):
    store = folder / "bulk"
    store.mkdir()

    def post(url, body, headers):
        import uuid

        from tidelog.sinks.writers import bulk_items

        assert url == "http://h:9200/_bulk"
        items = bulk_items(body.decode())
        (store / uuid.uuid4().hex).write_text(body.decode())
        return 200, {"items": [{a: {"status": 200}} for a, _ in items]}

    calls = []

    def request(method, url, body):
        calls.append((method, url.rsplit("/", 1)[-1], body))
        return (404, {}) if method == "GET" and len(calls) == 1 else (200, {"dw.people_out": {"mappings": {"properties": {"id": {"type": "byte"}}}}})

    sink = {"type": "elasticsearch", "hosts": ["http://h:9200"], "auto-create": True}
    transports = Transports(post=post, request=request, wait=0)
    run_batch(spark, sink_settings(folder, sink), source, transports=transports)
    assert [c[0] for c in calls] == ["GET", "PUT"] and calls[1][2]["mappings"]["properties"]["id"] == {"type": "long"}
    lines = [json.loads(x) for p in store.iterdir() for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines if "id" in x) == [1, 3, 7] and sum("delete" in x for x in lines) == 1
    change_lines(folder, "people", (5, "d", people(7, "bob"), None, None), more="2")
    with pytest.raises(SchemaError, match="too narrow"):
        run_batch(spark, sink_settings(folder, sink), source, transports=transports)


def test_doris_sink(spark, folder, source):
    store = folder / "loads"
    store.mkdir()
    made = []

    class Connection:
        def cursor(self):
            return self

        def execute(self, sql, args=()):
            made.append(sql)

        def commit(self):
            pass

        close = commit

    def put(url, label, body):
        assert url == "http://h:8030/api/dw/people_out/_stream_load"
        (store / label).write_text(body.decode())
        n = body.count(b"\n") + 1
        return {"Status": "Success", "NumberTotalRows": n, "NumberLoadedRows": n}

    there = {n: {"type": t, "nullable": n != "id", "default": False} for n, t in (("id", "BIGINT"), ("name", "VARCHAR(60)"), ("city", "STRING"))}
    transports = Transports(connect=Connection, catalog=lambda s, t: (there, ("id",)), put=put, wait=0)
    pipeline = sink_settings(folder, {"type": "doris", "hostname": "h", "username": "u", "password": "p"})
    with pytest.raises(SchemaError, match="key changed"):
        run_batch(spark, pipeline, source, transports=transports)
    assert made[0].startswith("CREATE TABLE IF NOT EXISTS `dw`.`people_out`") and not list(store.iterdir())
    change_lines(folder, "people", (1, "u", people(1, "alice"), people(1, "alice", "bj"), None))
    run_batch(spark, pipeline, source, transports=transports)
    rows = sorted((json.loads(x) for p in store.iterdir() for x in p.read_text().splitlines()), key=lambda r: r["id"])
    assert [(r["id"], r["city"]) for r in rows] == [(1, "bj"), (2, "sh"), (3, "hz")]
    names = {p.name for p in store.iterdir()}
    (folder / "ck").rename(folder / "lost")  # a replay of all of it makes the same loads
    run_batch(spark, pipeline, source, transports=transports)
    assert {p.name for p in store.iterdir()} == names


def test_kafka_sink(spark, folder, source):
    pipeline = sink_settings(folder, {"type": "kafka", "brokers": ["b:9092"], "topic": "all", "schema.change.emit.enabled": True})
    change_lines(folder, "people", (4, "ddl", None, None, "TRUNCATE shop.people"), more="2")
    run_batch(spark, pipeline, source, transports=Transports(kafka_format="json", kafka_options={"path": str(folder / "topic")}))
    rows = spark.read.json(str(folder / "topic")).collect()
    assert {r["topic"] for r in rows} == {"dw.people_out"} and sorted(json.loads(r["value"])["op"] for r in rows) == ["ddl", "r", "r", "r", "u", "u"]
    assert all(json.loads(r["value"])["ts_ms"] > 1_700_000_000_000 for r in rows) and {r["key"] for r in rows} == {"[1]", "[2]", "[3]", "[7]", None}


def test_catalog_rows():
    columns = [{"name": "id", "type": "bigint unsigned", "nullable": "NO", "extra": "auto_increment"}, {"name": "kind", "type": "enum('a','b')", "nullable": "YES", "default": "a", "charset": "utf8mb4"}, {"name": "at", "type": "datetime", "nullable": "YES", "extra": "DEFAULT_GENERATED", "default": "now()"}]
    indexes = [{"name": "u", "place": 2, "column": "id", "non_unique": 0}, {"name": "u", "place": 1, "column": "kind", "non_unique": 0, "prefix": 3}, {"name": "PRIMARY", "place": 1, "column": "id", "non_unique": 0}]
    t = table_from_catalog("d", "t", columns, indexes)
    assert t.primary_keys == ("id",) and t.column("id").type == "bigint unsigned" and t.column("id").auto_increment and not t.column("id").nullable
    assert t.indexes[0].columns == ("kind", "id") and t.indexes[0].unique and t.indexes[0].prefixes == (3, 0) and t.column("at").default_is_expression


def test_command_line(spark, folder, capsys):
    import yaml

    (folder / "p.yaml").write_text(yaml.safe_dump(SETTINGS | {"sink": {"type": "stdout"}, "checkpoint": {"file-path": str(folder / "ck")}}))
    assert main([str(folder / "p.yaml"), "--check"]) == 0 and main([]) == 2 and main([str(folder / "missing.yaml")]) == 1
    (folder / "bad.yaml").write_text("sink: {}")
    assert main([str(folder / "bad.yaml")]) == 1 and "source" in capsys.readouterr().err
    assert main([str(folder / "p.yaml"), "--source", str(folder / "src")]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["op"] for x in out] == ["r", "r", "d", "c"] and all(x["ts_ms"] > 1_700_000_000_000 for x in out)
    (folder / "q.yaml").write_text(yaml.safe_dump(SETTINGS | {"checkpoint": {"file-path": str(folder / "ck2")}}))
    assert main([str(folder / "q.yaml"), "--source", str(folder / "src"), "--target", str(folder / "o"), "--follow", "--available"]) == 0
    assert rows_of(spark, folder / "o", "dw.people_out", "id") == [(3, "ann"), (7, "bob")]
    assert main([str(folder / "q.yaml"), "--source", str(folder / "nowhere"), "--target", "/proc/nowhere"]) in (0, 1)


def test_logging(tmp_path, capsys):
    logger = set_up(Block(level="INFO", format="json", console=None, file=Block(path=str(tmp_path / "l/x.log"), rotation={"bytes": 200}, retention={"files": 1}, gzip=True)), "t1")
    for i in range(12):
        logger.info("line %s", i)
    logger.debug("hidden")
    names = sorted(p.name for p in (tmp_path / "l").iterdir())
    assert len(names) == 2 and names[1].endswith(".gz") and json.loads((tmp_path / "l/x.log").read_text().splitlines()[-1])["msg"] == "line 11"
    logger = set_up(Block(level="WARN", format="text", console=Block(stream="stdout"), file=None), "t2")
    logger.info("no")
    logger.warning("yes")
    assert "yes" in capsys.readouterr().out


def test_snapshot_loses_to_changes(spark):
    rows = spark.createDataFrame([(1, "old")], KIND)
    log = s.backfill(snapshot(rows, "d", "t"), spark.createDataFrame([("u", (1, "old"), (1, "new"), 5, None, "d", "t")], LOG))
    from tidelog.operators.apply import current_state

    assert [tuple(r) for r in current_state(log, ("id",)).collect()] == [(1, "new")]
