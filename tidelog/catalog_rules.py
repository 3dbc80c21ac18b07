"""Queries over the driver-side rules: names, types, statements and outcomes, each against values stated by hand.

A rule answers for one case; a query lists its answers for all its cases as rows, and its SQL lists what they must be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.filters import parse_filter
from .functions.typemap import create_doris, create_mysql, create_postgres, doris_default, doris_type, elastic_field, index_name, mapping_conflict, mysql_default, postgres_default, postgres_type
from .operators.encode import bulk_item, load_outcome, retryable, target_of, upsert_sql
from .operators.transform import compile_rule
from .plans import ddl
from .plans.evolve import Policy, doris_target_problems, postgres_widens, sink_outcome
from .plans.schema import Column, Index, SchemaError, Table, chunk_column, project_table
from .plans.selector import ConfigError, Selector, match_rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def answer(f: Callable, *arguments: object) -> str:
    """The rule's answer as text; ``refused`` where it raises, ``-`` for none."""
    try:
        out = f(*arguments)
    except (SchemaError, ConfigError, ValueError):
        return "refused"
    return "-" if out is None or out in ("", [], ()) else ",".join(map(str, out)) if isinstance(out, (list, tuple)) else str(out)


def rule(name: str, f: Callable, cases: list[tuple[tuple, str]]) -> None:
    """Register ``name``: rows ``place, answer`` of ``f`` over the cases (arguments, what must come out)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(i, answer(f, *arguments)) for i, (arguments, _) in enumerate(cases)], "place int, answer string")

    QUERIES[name] = run
    text = lambda x: "'" + x.replace("'", "''") + "'"
    ORACLE_SQL[name] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {text(expected)})" for i, (_, expected) in enumerate(cases)) + ") AS t(place, answer)"


def change_of(sql: str) -> list[str]:
    c = ddl.classify(sql)
    return [c.action, c.table or "-", c.column or "-", c.new_name or "-", *c.add_columns]


rule("ddl_classify", change_of, [
    (("CREATE TABLE IF NOT EXISTS `a`.`b` (id int)",), "create,b,-,-"), (("drop table if exists t",), "drop-table,t,-,-"), (("TRUNCATE a.b",), "truncate,b,-,-"), (("RENAME TABLE a TO b",), "rename-table,a,-,-"),
    (("ALTER TABLE t ADD COLUMN a int, ADD COLUMN b int",), "add-column,t,a,-,a,b"), (("ALTER TABLE t ADD age int",), "add-column,t,age,-,age"), (("ALTER TABLE t DROP COLUMN a, DROP COLUMN b",), "drop-column,t,a,-"),
    (("ALTER TABLE t CHANGE x y varchar(3)",), "rename-column,t,x,y"), (("ALTER TABLE t MODIFY COLUMN c decimal(10,2), ALGORITHM=INPLACE, LOCK=NONE",), "modify-column,t,c,-"), (("ALTER TABLE t ADD INDEX i (a), ADD COLUMN b int",), "other,t,-,-,b"),
    (("ALTER TABLE t DROP PRIMARY KEY",), "index,t,-,-"), (("ALTER TABLE t CONVERT TO CHARACTER SET utf8mb4",), "other,t,-,-"), (("CREATE INDEX i ON t (a)",), "index,-,-,-"), (("/* x */ alter table `t``q` rename column `a,b` to c -- y",), "rename-column,t`q,a,b,c"),
])
rule("ddl_add_columns", ddl.add_columns, [(("ALTER TABLE t ADD a int, ADD KEY k (a), ADD COLUMN `b c` text",), "a,b c"), (("ALTER TABLE t DROP COLUMN a",), "-")])
rule("ddl_decide", lambda sql, columns, truncate: ddl.decide(sql, columns, truncate).execute, [
    (("ALTER TABLE t ADD COLUMN a int", ("id", "A"), False), "True"), (("ALTER TABLE t ADD COLUMN a int", ("id",), False), "False"), (("ALTER TABLE t ADD COLUMN a int", (), False), "True"), (("TRUNCATE t", (), False), "False"),
    (("TRUNCATE t", (), True), "True"), (("CREATE TABLE t (id int)", (), True), "False"), (("RENAME TABLE a TO b", (), True), "False"), (("DROP TABLE t", (), True), "True"),
])
rule("ddl_rewrite_table", ddl.rewrite_table, [
    (("ALTER TABLE shop.orders ADD a int", "dw", "o"), "ALTER TABLE `dw`.`o` ADD a int"), (("truncate orders", "dw", "o`x"), "truncate `dw`.`o``x`"), (("DROP TABLE IF EXISTS `a`.`b`", "dw", "o"), "DROP TABLE IF EXISTS `dw`.`o`"),
])

KINDS = ("tinyint unsigned", "mediumint", "bigint unsigned", "decimal(10,4)", "char(8)", "char(100)", "varchar(30000)", "longtext", "datetime(6)", "time", "json", "enum('a')", "bit(8)", "blob", "point")
rule("types_doris", doris_type, list(zip([(k,) for k in KINDS], ("SMALLINT", "INT", "LARGEINT", "DECIMAL(10,4)", "CHAR(24)", "VARCHAR(300)", "STRING", "STRING", "DATETIME(6)", "refused", "JSONB", "refused", "refused", "refused", "refused"))))
rule("types_postgres", postgres_type, list(zip([(k,) for k in KINDS], ("SMALLINT", "INTEGER", "NUMERIC(20,0)", "NUMERIC(10,4)", "CHAR(8)", "CHAR(100)", "VARCHAR(30000)", "TEXT", "TIMESTAMP(6)", "refused", "JSON", "refused", "refused", "BYTEA", "refused"))))
rule("types_elastic", lambda k: elastic_field(k)["type"], list(zip([(k,) for k in KINDS], ("short", "integer", "unsigned_long", "keyword", "keyword", "keyword", "text", "text", "date", "keyword", "object", "keyword", "refused", "binary", "refused"))))

PEOPLE = Table("shop", "people", (Column("id", "bigint", False, True), Column("name", "varchar(10)", default="x'y"), Column("n", "decimal(5,1)", default="1.5"), Column("at", "timestamp", default="CURRENT_TIMESTAMP")), ("id",), (Index("u", ("name",), True),))
rule("create_table", lambda make: make(PEOPLE), [
    ((create_mysql,), "CREATE TABLE `shop`.`people` (`id` bigint NOT NULL AUTO_INCREMENT, `name` varchar(10) NULL DEFAULT 'x''y', `n` decimal(5,1) NULL DEFAULT 1.5, `at` timestamp NULL DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY (`id`), UNIQUE KEY `u` (`name`))"),
    ((create_postgres,), 'CREATE TABLE "public"."people" ("id" BIGINT NOT NULL, "name" VARCHAR(10) DEFAULT \'x\'\'y\', "n" NUMERIC(5,1) DEFAULT 1.5, "at" TIMESTAMP DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY ("id"), UNIQUE ("name"))'),
    ((create_doris,), "CREATE TABLE IF NOT EXISTS `shop`.`people` (\n  `id` BIGINT NOT NULL,\n  `name` VARCHAR(30) NULL DEFAULT 'x''y',\n  `n` DECIMAL(5,1) NULL DEFAULT 1.5,\n  `at` DATETIME(0) NULL\n) UNIQUE KEY(`id`)\nDISTRIBUTED BY HASH(`id`) BUCKETS auto"),
])
rule("defaults", lambda f, c, *kind: f(c, *kind), [
    ((mysql_default, Column("c", "int", default="5")), "5"), ((mysql_default, Column("c", "varchar(3)", default="")), "''"), ((mysql_default, Column("c", "int", default="a + 1", default_is_expression=True)), "(a + 1)"), ((mysql_default, Column("c", "int")), "-"),
    ((postgres_default, Column("c", "date", default="0000-00-00"), "DATE"), "-"), ((postgres_default, Column("c", "timestamp(3)", default="CURRENT_TIMESTAMP(3)"), "TIMESTAMP(3)"), "CURRENT_TIMESTAMP(3)"), ((postgres_default, Column("c", "text", default="7"), "TEXT"), "'7'"),
    ((doris_default, Column("c", "int", default="x"), "INT"), "refused"), ((doris_default, Column("c", "text", default="a\\b"), "STRING"), "'a\\\\b'"), ((doris_default, Column("c", "date", default="2024-01-02"), "DATE"), "'2024-01-02'"),
])
rule("upsert_statements", upsert_sql, [
    (("mysql", "d", "t`", ("id", "v"), ("id",)), "INSERT INTO `d`.`t``` (`id`, `v`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `id`=VALUES(`id`), `v`=VALUES(`v`)"),
    (("postgresql", "s", "t", ("id",), ("id",)), 'INSERT INTO "s"."t" ("id") VALUES ($1) ON CONFLICT ("id") DO NOTHING'), (("postgresql", "s", "t", ("a",), ()), 'INSERT INTO "s"."t" ("a") VALUES ($1)'), (("postgresql", "s", "t", ("a",), ("b",)), "refused"),
])
rule("postgres_target", target_of, [(("dw", "t", True, "app"), "dw,t"), (("dw", "t", False, "app"), "app,t"), (("dw", "t", False), "public,t")])
rule("retry_policy", retryable, [(("mysql", "", False), "True"), (("mysql", "", True), "False"), (("postgresql", "40001", False), "True"), (("postgresql", "23505", False), "False"), (("postgresql", "08006", False), "True"), (("postgresql", "08006", True), "False")])
rule("widening", postgres_widens, [
    (("INTEGER", "BIGINT"), "True"), (("BIGINT", "INTEGER"), "False"), (("INTEGER", "NUMERIC(9,0)"), "False"), (("NUMERIC(10,2)", "NUMERIC(12,3)"), "True"), (("NUMERIC(10,2)", "NUMERIC(10,3)"), "False"), (("VARCHAR(5)", "TEXT"), "True"),
    (("VARCHAR(5)", "CHAR(9)"), "False"), (("CHAR(5)", "VARCHAR(5)"), "True"), (("REAL", "DOUBLE PRECISION"), "True"), (("DATE", "TIMESTAMP"), "True"), (("TIMESTAMP(6)", "TIMESTAMP(3)"), "False"),
])

ADD, DROP = "ALTER TABLE d.t ADD COLUMN a int", "ALTER TABLE d.t DROP COLUMN a"
rule("schema_change_outcomes", lambda sink, sql, enabled, include, truncate: sink_outcome(ddl.classify(sql), Policy(sink, enabled, include, truncate)).verb, [
    (("stdout", ADD, False, (), False), "emit"), (("kafka", ADD, False, (), False), "skip"), (("mysql", ADD, False, (), False), "execute"), (("mysql", "TRUNCATE d.t", False, (), False), "skip"), (("mysql", "TRUNCATE d.t", False, (), True), "execute"),
    (("doris", ADD, True, ("add.column",), False), "execute"), (("doris", ADD, False, ("add.column",), False), "fail"), (("doris", DROP, True, ("add.column",), False), "fail"), (("doris", "DROP TABLE d.t", True, (), False), "skip"), (("doris", "ALTER TABLE d.t DROP PRIMARY KEY", True, (), False), "fail"),
    (("elasticsearch", ADD, True, (), False), "fail"), (("elasticsearch", "TRUNCATE d.t", True, (), False), "skip"), (("postgresql", DROP, True, ("drop.column",), False), "execute"), (("postgresql", DROP, True, ("add.column",), False), "fail"),
    (("postgresql", "TRUNCATE d.t", True, ("truncate",), True), "execute"), (("postgresql", "TRUNCATE d.t", True, ("truncate",), False), "skip"), (("postgresql", "ALTER TABLE d.t ADD INDEX i (a)", True, (), False), "skip"), (("postgresql", "ALTER TABLE d.t ADD UNIQUE KEY i (a)", True, (), False), "fail"),
    (("mysql", "ALTER TABLE d.t CONVERT TO CHARACTER SET x", True, (), True), "fail"), (("postgresql", "CREATE TABLE d.t (id int)", True, (), True), "skip"),
])

LOADED = {"Status": "Success", "NumberTotalRows": 3, "NumberLoadedRows": 3}
rule("load_outcomes", load_outcome, [
    ((LOADED, "l", 3), "success"), ((LOADED, "l", 4), "fatal"), ((LOADED | {"NumberFilteredRows": 1}, "l", 3), "fatal"), ((LOADED | {"Label": "other"}, "l", 3), "unknown"), (({"Status": "Publish Timeout"}, "l", 3), "success"), (({"Status": "Fail"}, "l", 3), "fatal"),
    (({"Status": "Label Already Exists", "ExistingJobStatus": "FINISHED"}, "l", 3), "success"), (({"Status": "Label Already Exists", "ExistingJobStatus": "RUNNING"}, "l", 3), "label-exists"), ((None, "l", 3), "unknown"),
])
rule("bulk_item_outcomes", bulk_item, [(("index", 201), "ok"), (("delete", 404), "ok"), (("index", 404), "fail"), (("index", 429), "retry"), (("delete", 503), "retry"), (("index", 400), "fail")])
rule("index_names", index_name, [(("shop", "orders"), "shop.orders"), (("shop", "orders", "all"), "all"), (("_a", "b"), "cdc_a.b-4e7bafc2a142")])
rule("mapping_conflicts", lambda c, target: "fits" if mapping_conflict(c, target) is None else "conflict", [
    ((Column("c", "int"), {"type": "long"}), "fits"), ((Column("c", "bigint"), {"type": "integer"}), "conflict"), ((Column("c", "int"), {"type": "unsigned_long"}), "conflict"), ((Column("c", "int unsigned"), {"type": "unsigned_long"}), "fits"),
    ((Column("c", "varchar(9)"), {"type": "text"}), "fits"), ((Column("c", "date"), {"type": "date", "format": "yyyy"}), "conflict"), ((Column("c", "json"), {"type": "object", "dynamic": True}), "fits"),
])
THERE = {"id": {"type": "BIGINT", "nullable": False}, "name": {"type": "VARCHAR(30)", "nullable": True}, "n": {"type": "DECIMAL(5,1)", "nullable": True}, "at": {"type": "DATETIME(0)", "nullable": True}}
rule("target_problems", lambda there, keys: len(doris_target_problems(PEOPLE, there, keys)), [
    ((THERE, ("id",)), "0"), ((THERE, ("ID",)), "0"), ((THERE, ("name",)), "1"), ((THERE | {"name": {"type": "VARCHAR(9)", "nullable": True}}, ("id",)), "1"), ((THERE | {"x": {"type": "INT", "nullable": False}}, ("id",)), "1"), ((THERE | {"x": {"type": "INT", "nullable": False, "default": True}}, ("id",)), "0"),
])

RULES = [compile_rule(r"shop\.o.*", "id, `name`", "", "id"), compile_rule(r"shop\..*", "*")]
rule("projection_rules", lambda d, t: (lambda r: None if r is None else [*r.columns, "|", *r.keys])(match_rule(RULES, d, t)), [(("shop", "orders"), "id,name,|,id"), (("shop", "people"), "|"), (("web", "x"), "-")])
rule("projected_tables", lambda columns, keys: (lambda t: [*(c.name for c in t.columns), "|", *t.primary_keys, "|", *(i.name for i in t.indexes)])(project_table(PEOPLE, columns, keys)), [
    (((), ()), "id,name,n,at,|,id,|,u"), ((("NAME", "n"), ()), "NAME,n,|,|,u"), ((("id",), ("id",)), "id,|,id,|"), ((("gone",), ()), "refused"),
])
rule("projection_lists", lambda text: compile_rule("x", text).columns, [(("a , `b c`,, d",), "a,b c,d"), (("*",), "-"), (("*, a",), "refused")])
rule("chunk_keys", chunk_column, [((PEOPLE,), "id"), ((PEOPLE, "n"), "refused"), ((PEOPLE, "gone"), "refused"), ((Table("d", "t", (Column("j", "json", False),), ("j",)),), "refused"), ((Table("d", "t"),), "refused")])
rule("filter_errors", lambda text: "parsed" if parse_filter(text) else "", [
    (("a = 1 AND (b <> 'x' OR NOT c IS NULL)",), "parsed"), (("a =",), "refused"), (("a = 1 AND",), "refused"), (("(a = 1",), "refused"), (("a LIKE 5",), "refused"), (("a IN ()",), "refused"), (("a ~ 1",), "refused"), (("a = 'x",), "refused"),
])
rule("selected_tables", lambda include, exclude, d, t: Selector.of(include, exclude).matches(d, t), [
    ((r"shop\..*", "", "shop", "orders"), "True"), ((r"shop\..*", r"shop\.tmp_.*", "shop", "tmp_1"), "False"), ((r".*", "", "mysql", "user"), "False"), ((r"shop\.a|shop\.ab", "", "shop", "ab"), "False"), (("", "", "shop", "a"), "refused"), (("(?=x)", "", "a", "b"), "refused"),
])
