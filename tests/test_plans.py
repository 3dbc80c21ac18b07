import copy

import pytest

from tidelog.plans import ddl, evolve
from tidelog.plans import schema as s
from tidelog.plans.config import ConfigError, as_rotation, as_seconds, checkpoint_path, load_pipeline, parse_pipeline
from tidelog.plans.selector import Route, Selector, colliding_targets, compile_pattern, full_match, resolve_routes

# --- names ----------------------------------------------------------------------------


def test_full_match_takes_the_first_alternative():
    assert not full_match(compile_pattern("t", r"db\.(t|t1)"), "db.t1")
    assert full_match(compile_pattern("t", r"db\.(t1|t)"), "db.t1") and not full_match(compile_pattern("t", r"db\.t"), "db.t1")
    for bad in ("(", r"(?=x)", r"(a)\1"):
        with pytest.raises(ConfigError):
            compile_pattern("t", bad)


def test_selector():
    own = Selector.of(r"shop\..*, web\.a", r"shop\.tmp_.*")
    assert own.matches("shop", "orders") and own.matches("web", "a")
    assert not own.matches("shop", "tmp_x") and not own.matches("web", "ab") and not Selector.of(".*").matches("MySQL", "user")
    with pytest.raises(ConfigError):
        Selector.of(" , ")


def test_routes():
    routes = [Route(compile_pattern("r", r"a\..*"), "s.all"), Route(compile_pattern("r", r"a\.x"), "s.<>_<>", "<>")]
    assert resolve_routes(routes, "a", "x") == [("s", "all", True), ("s", "x_x", True)]
    assert resolve_routes(routes, "a", "x", first_only=True) == [("s", "all", True)]
    assert resolve_routes(routes, "b", "x") == [("b", "x", False)]
    assert list(colliding_targets(routes, [("a", "x"), ("a", "y")])) == [("s", "all")]
    with pytest.raises(ConfigError):
        Route(compile_pattern("r", "x"), "nodot").target("t")


# --- DDL --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("sql", "action", "database", "table", "column", "new"),
    [
        ("CREATE TABLE IF NOT EXISTS `d b`.`u` (id int)", "create", "d b", "u", "", ""),
        ("ALTER TABLE d.u ADD COLUMN age int", "add-column", "d", "u", "age", ""),
        ("alter table u add age int", "add-column", "", "u", "age", ""),
        ("ALTER TABLE u DROP COLUMN age", "drop-column", "", "u", "age", ""),
        ("ALTER TABLE u CHANGE COLUMN name full varchar(32)", "rename-column", "", "u", "name", "full"),
        ("ALTER TABLE u CHANGE a b int", "rename-column", "", "u", "a", "b"),
        ("ALTER TABLE u RENAME COLUMN name TO full", "rename-column", "", "u", "name", "full"),
        ("ALTER TABLE u MODIFY age bigint", "modify-column", "", "u", "age", ""),
        ("DROP TABLE IF EXISTS d.u", "drop-table", "d", "u", "", ""),
        ("TRUNCATE d.u", "truncate", "d", "u", "", ""),
        ("TRUNCATE TABLE d.u;", "truncate", "d", "u", "", ""),
        ("RENAME TABLE d.u TO d.p", "rename-table", "d", "u", "", ""),
        ("ALTER TABLE u RENAME TO p", "rename-table", "", "u", "", ""),
        ("/* c */ ALTER -- x\n TABLE d.u ADD FULLTEXT INDEX ft (b)", "index", "d", "u", "", ""),
        ("ALTER TABLE u DROP PRIMARY KEY", "index", "", "u", "", ""),
        ("ALTER TABLE u DROP age", "other", "", "u", "", ""),
        ("ALTER TABLE u ADD COLUMN a int, ADD INDEX i (a)", "other", "", "u", "", ""),
        ("ALTER TABLE u ADD COLUMN a int, ADD CONSTRAINT c CHECK (a > 0)", "other", "", "u", "", ""),
        ("ALTER TABLE u ADD COLUMN a int, ALGORITHM=INPLACE, LOCK=NONE", "add-column", "", "u", "a", ""),
        ("ALTER TABLE u ADD COLUMN n varchar(9) DEFAULT 'a,b'", "add-column", "", "u", "n", ""),
        ("ALTER TABLE u ADD COLUMN `odd,name` int, ADD KEY k (`odd,name`)", "other", "", "u", "", ""),
        ("ALTER TABLE u ALTER COLUMN a SET DEFAULT 1", "other", "", "u", "", ""),
        ("ALTER TABLE u CONVERT TO CHARACTER SET utf8mb4", "other", "", "u", "", ""),
        ("CREATE UNIQUE INDEX i ON u (a)", "index", "", "", "", ""),
        ("SELECT 1", "other", "", "", "", ""),
    ],
)
def test_classify(sql, action, database, table, column, new):
    got = ddl.classify(sql)
    assert (got.action, got.database, got.table, got.column, got.new_name) == (action, database, table, column, new)


@pytest.mark.parametrize(
    ("sql", "columns"),
    [
        ("ALTER TABLE d.t ADD COLUMN a int, ADD COLUMN b varchar(8)", ["a", "b"]),
        ("ALTER TABLE d.t ADD COLUMN a int, ADD INDEX i (a), ADD b int", ["a", "b"]),
        (r"ALTER TABLE d.t ADD COLUMN n VARCHAR(64) DEFAULT 'it\'s,a value', ADD COLUMN age INT", ["n", "age"]),
        (r"ALTER TABLE d.t ADD COLUMN n VARCHAR(64) DEFAULT 'a\\\'b,c', ADD COLUMN age INT", ["n", "age"]),
        ("ALTER TABLE d.t ADD COLUMN n VARCHAR(64) DEFAULT 'it''s,x', ADD COLUMN age decimal(10,2)", ["n", "age"]),
        ("ALTER TABLE d.t ADD UNIQUE KEY k (n)", []),
        ("CREATE TABLE d.t (id int)", []),
    ],
)
def test_add_columns(sql, columns):
    assert ddl.add_columns(sql) == columns


def test_decide_and_rewrite():
    assert ddl.decide("ALTER TABLE u ADD COLUMN age int", ["ID", "AGE"]).execute
    assert not ddl.decide("ALTER TABLE u ADD COLUMN age int", ["id"]).execute
    assert ddl.decide("DROP TABLE u", drop_truncate=True).execute and not ddl.decide("DROP TABLE u").execute
    assert not ddl.decide("CREATE TABLE u (a int)", drop_truncate=True).execute
    assert ddl.rewrite_table("ALTER TABLE `d`.`u` ADD COLUMN u int", "x", "y`z") == "ALTER TABLE `x`.`y``z` ADD COLUMN u int"
    assert ddl.rewrite_table("TRUNCATE u", "x", "y") == "TRUNCATE `x`.`y`" and ddl.rewrite_table("SELECT 1", "x", "y") == "SELECT 1"
    assert ddl.rewrite_table("DROP TABLE IF EXISTS u", "x", "y") == "DROP TABLE IF EXISTS `x`.`y`"


# --- evolution ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("old", "new", "ok"),
    [
        ("SMALLINT", "BIGINT", True), ("BIGINT", "INTEGER", False), ("INTEGER", "NUMERIC(10)", True), ("INTEGER", "NUMERIC(10,2)", False), ("BIGINT", "NUMERIC(20,0)", True),
        ("NUMERIC(10,2)", "NUMERIC(12,2)", True), ("NUMERIC(10,2)", "NUMERIC(11,4)", False), ("CHAR(4)", "VARCHAR(4)", True), ("VARCHAR(4)", "CHAR(9)", False), ("VARCHAR(9)", "VARCHAR(8)", False),
        ("VARCHAR(9)", "TEXT", True), ("TEXT", "VARCHAR(9)", False), ("REAL", "DOUBLE PRECISION", True), ("DATE", "TIMESTAMP", True), ("TIMESTAMP(3)", "TIMESTAMP(6)", True), ("TIMESTAMP(6)", "TIMESTAMP(3)", False),
        ("TIMESTAMP", "DATE", False), ("JSON", "JSON", True), ("JSON", "TEXT", False), ("NUMERIC(10,0)", "NUMERIC(10)", True), ("INTEGER", "TEXT", False),
    ],
)
def test_widening(old, new, ok):
    assert evolve.postgres_widens(old, new) is ok


@pytest.mark.parametrize(("old", "new", "ok"), [("INT", "BIGINT", True), ("LARGEINT", "BIGINT", False), ("CHAR(6)", "VARCHAR(6)", True), ("VARCHAR(6)", "STRING", True), ("DECIMAL(10,2)", "DECIMAL(12,4)", True), ("DECIMAL(10,2)", "DECIMAL(11,4)", False), ("DATETIME(6)", "DATETIME(3)", False), ("FLOAT", "DOUBLE", True), ("STRING", "VARCHAR(9)", False), ("JSONB", "JSONB", True), ("DATE", "DATETIME(0)", False)])
def test_loads_fit(old, new, ok):
    assert evolve.doris_fits(old, new) is ok


ADD, TWO, DROP, INDEX, KEYED = "ALTER TABLE d.u ADD COLUMN a int", "ALTER TABLE d.u ADD COLUMN a int, ADD COLUMN b int", "DROP TABLE d.u", "ALTER TABLE d.u ADD INDEX i (a)", "ALTER TABLE d.u DROP PRIMARY KEY"
ALL = tuple(evolve.KINDS.values())


@pytest.mark.parametrize(
    ("sink", "sql", "options", "verb"),
    [
        ("stdout", DROP, {}, "emit"), ("kafka", ADD, {}, "skip"), ("kafka", ADD, {"emit": True}, "emit"), ("mysql", ADD, {}, "execute"), ("mysql", DROP, {}, "skip"), ("mysql", DROP, {"drop_truncate": True}, "execute"), ("mysql", INDEX, {}, "skip"),
        ("elasticsearch", ADD, {}, "fail"), ("elasticsearch", DROP, {}, "skip"), ("elasticsearch", DROP, {"drop_truncate": True}, "fail"), ("elasticsearch", INDEX, {}, "skip"),
        ("doris", ADD, {"enabled": True, "include": ("add.column",)}, "execute"), ("doris", TWO, {"enabled": True, "include": ("add.column",)}, "fail"), ("doris", ADD, {}, "fail"), ("doris", DROP, {}, "skip"), ("doris", INDEX, {}, "skip"), ("doris", KEYED, {}, "fail"),
        ("postgresql", TWO, {"enabled": True, "include": ALL}, "execute"), ("postgresql", ADD, {"enabled": True}, "fail"), ("postgresql", DROP, {"enabled": True, "include": ALL}, "skip"), ("postgresql", DROP, {"enabled": True, "include": ALL, "drop_truncate": True}, "execute"),
        ("postgresql", INDEX, {}, "skip"), ("postgresql", KEYED, {}, "fail"), ("postgresql", "RENAME TABLE d.u TO d.v", {}, "fail"), ("mysql", "ALTER TABLE d.u CONVERT TO CHARACTER SET x", {}, "fail"), ("mysql", "CREATE TABLE d.u (a int)", {}, "skip"),
    ],
)
def test_policy(sink, sql, options, verb):
    assert evolve.sink_outcome(ddl.classify(sql), evolve.Policy(sink, **options)).verb == verb


def own_table():
    return s.Table("d", "u", (s.Column("id", "bigint", False), s.Column("name", "varchar(8)"), s.Column("age", "int")), ("id",), (s.Index("uk", ("name",), True),))


def planned(sql, **definitions):
    return evolve.plan_change(own_table(), ddl.classify(sql), definitions)


def test_plan_change_and_replay():
    new = s.Column("note", "varchar(9)")
    done = planned("ALTER TABLE u ADD note varchar(9)", note=new)
    assert [c.name for c in done.table.columns] == ["id", "name", "age", "note"]
    assert isinstance(evolve.plan_change(done.table, ddl.classify("ALTER TABLE u ADD note varchar(9)"), {"note": new}), evolve.NoOp)
    assert isinstance(planned("ALTER TABLE u ADD note varchar(9)"), evolve.Refused)
    assert isinstance(planned("ALTER TABLE u ADD note int", note=s.Column("note", "int", False)), evolve.Refused)
    assert isinstance(planned("ALTER TABLE u ADD age text", age=s.Column("age", "text")), evolve.Refused)
    assert isinstance(planned("ALTER TABLE u DROP COLUMN name"), evolve.Refused) and isinstance(planned("ALTER TABLE u DROP COLUMN zzz"), evolve.NoOp)
    assert [c.name for c in planned("ALTER TABLE u DROP COLUMN age").table.columns] == ["id", "name"]
    renamed = planned("ALTER TABLE u RENAME COLUMN id TO uid").table
    assert renamed.primary_keys == ("uid",)
    assert isinstance(evolve.plan_change(renamed, ddl.classify("ALTER TABLE u RENAME COLUMN id TO uid")), evolve.NoOp)
    assert isinstance(planned("ALTER TABLE u RENAME COLUMN x TO y"), evolve.Refused) and isinstance(planned("ALTER TABLE u RENAME COLUMN age TO name"), evolve.Refused)
    assert planned("ALTER TABLE u MODIFY age bigint", age=s.Column("age", "bigint")).table.column("age").type == "bigint"
    assert isinstance(planned("ALTER TABLE u MODIFY age smallint", age=s.Column("age", "tinyint")), evolve.Refused)


def test_targets():
    target = {"id": {"type": "BIGINT", "nullable": False}, "name": {"type": "VARCHAR(24)", "nullable": True}, "age": {"type": "SMALLINT", "nullable": False}, "z": {"type": "INT", "nullable": False}}
    problems = evolve.doris_target_problems(own_table(), target, ("id",))
    assert len(problems) == 2 and "age" in problems[0] and "extra column z" in problems[1]
    assert evolve.doris_target_problems(own_table(), {}, ("x",))[0].startswith("keys")
    good = {"id": {"type": "BIGINT", "nullable": False}, "name": {"type": "VARCHAR(8)", "nullable": True}}
    assert evolve.postgres_target_problems(own_table(), good, ("id",)) == []
    assert evolve.postgres_target_problems(own_table(), good | {"age": {"type": "BIGINT", "nullable": True}}, ("id",))


def test_missing_columns_and_keys():
    assert [c.name for c in evolve.missing_columns(own_table(), {"ID": {}, "name": {}}, True)] == ["age"]
    evolve.check_keys(own_table(), ("ID",))
    for bad in (lambda: evolve.missing_columns(own_table(), {}, False), lambda: evolve.check_keys(own_table(), ("id", "name"))):
        with pytest.raises(s.SchemaError):
            bad()


# --- schema ------------------------------------------------------------------------------


def test_project_table_and_chunk_key():
    cut = s.project_table(own_table(), ("ID", "age"))
    assert [c.name for c in cut.columns] == ["ID", "age"] and cut.primary_keys == ("id",) and cut.indexes == ()
    assert s.project_table(own_table(), ("name",)).primary_keys == () and s.project_table(own_table(), (), ("name",)).primary_keys == ("name",)
    with pytest.raises(s.SchemaError):
        s.project_table(own_table(), ("nope",))
    assert s.chunk_column(own_table()) == "id"
    for bad in ("name", "nope"):
        with pytest.raises(s.SchemaError):
            s.chunk_column(own_table(), bad)
    with pytest.raises(s.SchemaError):
        s.chunk_column(s.Table("d", "t", (s.Column("a", "json", False),), ("a",)))
    with pytest.raises(s.SchemaError):
        s.chunk_column(s.Table("d", "t"))


@pytest.mark.parametrize(("kind", "out"), [("bigint unsigned", "decimal(20,0)"), ("tinyint(1)", "tinyint"), ("int unsigned", "bigint"), ("decimal(10,4)", "decimal(10,4)"), ("time(3)", "string"), ("enum('a','b')", "string"), ("datetime(6)", "timestamp_ntz"), ("year", "smallint"), ("longblob", "binary"), ("double", "double")])
def test_spark_types(spark, kind, out):
    assert s.spark_type(kind).simpleString() == out


def test_unsupported_types(spark):
    for kind in ("vector(3)", "point", ""):
        with pytest.raises(s.SchemaError):
            s.spark_type(kind)
    assert s.parse_type("enum('a','it''s')").labels == ("a", "it's")


# --- settings ---------------------------------------------------------------------------------

GOOD = {
    "source": {"hostname": "h", "username": "u", "password": "p", "tables": r"shop\..*"},
    "sink": {"type": "mysql", "hostname": "h", "username": "u", "password": "p"},
    "route": [{"source-table": r"shop\.(.*)", "sink-table": "dw.<>", "replace-symbol": "<>"}],
    "transform": [{"source-table": r"shop\.a", "projection": "id, `b`", "filter": "id > 3", "primary-keys": "id", "partition-keys": "x"}],
    "pipeline": {"name": "a/b"},
}


def test_defaults():
    own = load_pipeline(GOOD)
    assert (own.source.port, own.source.chunk_size, own.source.fetch_size, own.source.mode, own.source.time_zone) == (3306, 8096, 1024, "initial", "UTC")
    assert (own.sink.batch_size, own.sink.max_retries, own.sink.auto_create) == (1000, 3, True) and own.runtime.route_mode == "ALL_MATCH"
    assert own.rules[0].columns == ("id", "b") and own.rules[0].keys == ("id",)
    assert own.checkpoint.file_path == checkpoint_path("./checkpoints", "a/b") and "a_b" in own.checkpoint.file_path
    pg = load_pipeline(GOOD | {"sink": GOOD["sink"] | {"type": "postgresql", "database": "d"}}).sink
    assert (pg.port, pg.schema, pg.sslmode, pg.auto_create) == (5432, "public", "prefer", False)
    es = load_pipeline(GOOD | {"sink": {"type": "elasticsearch", "hosts": "http://a,http://b", "bulk-max-bytes": 0}}).sink
    assert (es.version, es.auto_create, es.bulk_bytes, es.hosts) == (8, False, 5 << 20, ["http://a", "http://b"])
    doris = load_pipeline(GOOD | {"sink": {"type": "doris", "hostname": "h", "username": "u"}}).sink
    assert (doris.port, doris.sql_port, doris.include, doris.buckets) == (8030, 9030, ["add.column"], "auto")


@pytest.mark.parametrize(
    ("path", "value", "field"),
    [
        ("extra", {}, "extra"), ("source.debezium.x", 1, "source.debezium.x"), ("source.zzz", 1, "source.zzz"), ("source.snapshot-mode", 1, "source.snapshot-mode"), ("source.port", "x", "source.port"), ("source.hostname", "", "source.hostname"),
        ("source.tables", "", "source.tables"), ("source.tables", "(", "source.tables"), ("source.scan.startup.mode", "never", "source.scan.startup.mode"), ("source.scan.startup.mode", "timestamp", "source.scan.startup.timestamp-millis"),
        ("source.scan.startup.mode", "specific-offset", "source.scan.startup.specific-offset"), ("source.connect.timeout", "10ms", "source.connect.timeout"), ("source.scan.incremental.snapshot.chunk.size", 0, "source.scan.incremental.snapshot.chunk.size"),
        ("source.server-id", -1, "source.server-id"), ("source.jdbc.properties.", 1, "source.jdbc.properties."), ("source.type", "oracle", "source.type"),
        ("sink.type", "oracle", "sink.type"), ("sink.brokers", "x", "sink.brokers"), ("sink.schema", "x", "sink.schema"), ("sink.version", 8, "sink.version"), ("sink.zzz", 8, "sink.zzz"), ("sink.write-batch-size", 0, "sink.write-batch-size"),
        ("sink.request-timeout", "1s", "sink.request-timeout"), ("sink.delete.enabled", True, "sink.delete.enabled"), ("sink.password", "", "sink.password"),
        ("route", {}, "route"), ("route", [{"source-table": "x", "sink-table": "y"}], "route"), ("route", [{"source-table": "x", "sink-table": "a.b", "q": 1}], "route"), ("transform", [{"projection": "x"}], "transform"),
        ("transform", [{"source-table": "x", "projection": "*, a"}], "transform.projection"), ("transform", [{"source-table": "x", "filter": "a ="}], "transform"), ("pipeline", {}, "pipeline"), ("pipeline.route-mode", "SOME", "pipeline.route-mode"),
        ("pipeline.parallelism", 0, "pipeline.parallelism"), ("checkpoint", {"storage": "mysql"}, "checkpoint.storage"), ("checkpoint", {"interval": 0}, "checkpoint.interval"), ("logging", {"level": "loud"}, "logging.level"), ("logging", {"file": {}}, "logging.file.path"),
    ],
)
def test_rejections(path, value, field):
    root = copy.deepcopy(GOOD)
    block, _, key = path.partition(".")
    if key:
        root[block][key] = value
    else:
        root[block] = value
    with pytest.raises(ConfigError) as e:
        load_pipeline(root)
    assert e.value.field == field


@pytest.mark.parametrize(("kind", "own"), [("doris", {"partial-update.enabled": True}), ("doris", {"schema.change.include": "drop.column"}), ("doris", {"buckets": "0"}), ("doris", {"hostname": "http://h"}), ("postgresql", {}), ("postgresql", {"database": "a.b"}), ("postgresql", {"database": "d", "sslmode": "x"}), ("postgresql", {"database": "d", "schema.change.include": "index"}), ("kafka", {"brokers": "b"}), ("kafka", {"brokers": "b", "topic": "a b"}), ("elasticsearch", {"hosts": "ftp://x"}), ("elasticsearch", {"hosts": "http://x", "version": 6}), ("elasticsearch", {"hosts": "http://x", "index-name": "Aa"}), ("elasticsearch", {"hosts": "http://x", "bulk-max-bytes": 5})])
def test_sink_rejections(kind, own):
    base = {} if kind in ("kafka", "elasticsearch") else {"hostname": "h", "username": "u", "password": "p"}
    with pytest.raises(ConfigError):
        load_pipeline(GOOD | {"sink": base | {"type": kind} | own})


def test_yaml_and_readers():
    assert parse_pipeline("source: {hostname: h, username: u, password: p, tables: 'a\\..*'}\nsink: {type: stdout}\npipeline: {name: x}\n").sink.type == "stdout"
    for bad in ("", "[1]", "a: ["):
        with pytest.raises(ConfigError):
            parse_pipeline(bad)
    assert as_seconds("1m30s") == 90 and as_seconds(250) == 0.25 and as_rotation("02:30") == {"daily_at": (2, 30)} and as_rotation("1.5 KB") == {"bytes": 1536} and as_rotation("2 days") == {"seconds": 172800}
    for bad in ("x", "25:00", "0 MB"):
        with pytest.raises(ValueError):
            as_rotation(bad)
