from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import canonical as c
from tidelog.functions import typemap as t
from tidelog.plans.schema import Column, Index, SchemaError, Table


def run(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


CASES = [
    (lambda v: c.decimal(v, 2, False), ["1.5", "+001.50", "-0.00", ".5", "5.", "1.234", "1.2300", "x", "", None, "-0.01", "12345678901234567890123456789012345678901234567890.1"], ["1.50", "1.50", "0.00", "0.50", "5.00", None, "1.23", None, None, None, "-0.01", "12345678901234567890123456789012345678901234567890.10"]),
    (lambda v: c.decimal(v, 0, False), ["7", "-0", "007.0", "7.1"], ["7", "0", "7", None]),
    (lambda v: c.date(v, False), ["2024-02-29", "2023-02-29", " 1970-01-01 ", "1970-1-1", None], ["2024-02-29", None, "1970-01-01", None, None]),
    (lambda v: c.datetime(v, False), ["2024-03-15 13:45:30", "2024-03-15T13:45:30.5", "2024-03-15 25:00:00", "2024-03-15"], ["2024-03-15 13:45:30.000000", "2024-03-15 13:45:30.500000", None, None]),
    (lambda v: c.time(v, False), ["1:2:3", "-00:00:00.000", "838:59:59.1234567", "839:00:00", "1:60:00", "1:2", "-0:00:01", "1:02:03.x"], ["1:02:03.000000", "0:00:00.000000", "838:59:59.123456", None, None, None, "-0:00:01.000000", None]),
    (lambda v: c.year(v, False), ["0", "1999", "10000", "x"], ["0000", "1999", None, None]),
    (lambda v: c.enum(v, ("2", "1"), False, False), ["2", "", "3", None], ["2", "", None, None]),
    (lambda v: c.set_(v, ("a", "b"), False, False), ["a", "b,a", "", "a,c"], ["a", "b,a", "", None]),
    (lambda v: c.integer(v, False), ["-5", " 7 ", "9223372036854775808", "1.0"], ["-5", "7", None, None]),
    (lambda v: c.unsigned(v, False), ["18446744073709551615", "18446744073709551616", "-1", "0"], ["18446744073709551615", None, None, "0"]),
    (lambda v: c.floating(v, "double", False), ["1.5", "NaN", "Infinity", "x"], ["1.5", None, None, None]),
    (lambda v: c.json(v, False), ['{ "a" : [1, 2] }', "{", None], ['{"a":[1,2]}', None, None]),
]


@pytest.mark.parametrize(("function", "values", "expected"), CASES)
def test_canonical(spark, function, values, expected):
    assert run(spark, function, values) == expected


def test_from_numbers_and_bytes(spark):
    assert run(spark, lambda v: c.enum(v, ("red", "green"), True, False), [0, 1, 2, 3, None], "bigint") == ["", "red", "green", None, None]
    assert run(spark, lambda v: c.set_(v, ("x", "y", "z"), True, False), [0, 5, 7, 8], "bigint") == ["", "x,z", "x,y,z", None]
    many = tuple(f"m{i}" for i in range(64))
    assert run(spark, lambda v: c.set_(v, many, True), [-(2**63) + 1], "bigint") == ["m0,m63"]
    assert run(spark, c.binary, [b"", b"\xff" * 60, None], "binary") == ["", "/" * 80, None]
    assert run(spark, lambda v: c.decimal(v, 4), [Decimal("1.5")], "decimal(10,2)") == ["1.5000"]


def test_strict_raises(spark):
    with pytest.raises(Exception, match="no decimal: x"):
        run(spark, lambda v: c.decimal(v, 2), ["x"])


def test_utc(spark):
    out = run(spark, lambda v: c.timestamp_utc(v, "Asia/Shanghai"), ["2024-03-15 13:45:30.123456", None])
    assert out == ["2024-03-15 05:45:30.123456", None] and run(spark, lambda v: c.timestamp_utc(v, "UTC"), ["2024-03-15 13:45:30"]) == ["2024-03-15 13:45:30.000000"]


def test_ids_cannot_be_confused(spark):
    one = c.document_id("d.t", [("a", F.lit("bc")), ("d", F.lit("e"))])
    two = c.document_id("d.t", [("ab", F.lit("c")), ("d", F.lit("e"))])
    assert spark.range(1).select(one != two).first()[0]


@pytest.mark.parametrize(
    ("kind", "doris", "postgres", "elastic"),
    [
        ("tinyint", "TINYINT", "SMALLINT", "byte"), ("tinyint unsigned", "SMALLINT", "SMALLINT", "short"), ("tinyint(1) unsigned", "SMALLINT", "SMALLINT", "byte"), ("smallint unsigned", "INT", "INTEGER", "integer"), ("mediumint", "INT", "INTEGER", "integer"),
        ("mediumint unsigned", "INT", "BIGINT", "integer"), ("int", "INT", "INTEGER", "integer"), ("int(11) unsigned", "BIGINT", "BIGINT", "long"), ("bigint", "BIGINT", "BIGINT", "long"), ("bigint unsigned", "LARGEINT", "NUMERIC(20,0)", "unsigned_long"),
        ("float", "FLOAT", "REAL", "float"), ("double", "DOUBLE", "DOUBLE PRECISION", "double"), ("decimal(10,4)", "DECIMAL(10,4)", "NUMERIC(10,4)", "keyword"), ("decimal(60,0)", None, "NUMERIC(60)", "keyword"), ("decimal", None, "NUMERIC(10,0)", "keyword"),
        ("char(8)", "CHAR(24)", "CHAR(8)", "keyword"), ("char(100)", "VARCHAR(300)", "CHAR(100)", "keyword"), ("varchar(64)", "VARCHAR(192)", "VARCHAR(64)", "keyword"), ("varchar(30000)", "STRING", "VARCHAR(30000)", "text"), ("longtext", "STRING", "TEXT", "text"),
        ("date", "DATE", "DATE", "date"), ("datetime(6)", "DATETIME(6)", "TIMESTAMP(6)", "date"), ("timestamp", "DATETIME(0)", "TIMESTAMP", "date"), ("year", "SMALLINT", "SMALLINT", "date"), ("time", None, None, "keyword"), ("json", "JSONB", "JSON", "object"),
        ("enum('a')", None, None, "keyword"), ("bit(8)", None, None, None), ("blob", None, "BYTEA", "binary"), ("point", None, None, None),
    ],
)
def test_type_maps(kind, doris, postgres, elastic):
    for function, out in ((t.doris_type, doris), (t.postgres_type, postgres), (lambda k: t.elastic_field(k)["type"], elastic)):
        if out is None:
            with pytest.raises(SchemaError):
                function(kind)
        else:
            assert function(kind) == out
    assert t.mysql_type(kind) == kind


def test_create_tables():
    own = Table(
        "d", "t`x", (Column("name", "varchar(8)", default="", comment="it's", charset="utf8mb4"), Column("id", "bigint", False, auto_increment=True), Column("at", "datetime", default="CURRENT_TIMESTAMP"), Column("n", "int", default="5"), Column("e", "int", default="uuid()", default_is_expression=True)),
        ("id",), (Index("uk", ("name",), True), Index("ft", ("name",), type="FULLTEXT"), Index("pre", ("name",), True, (3,))), charset="utf8mb4", comment="c",
    )
    sql = t.create_mysql(own)
    assert sql == (
        "CREATE TABLE `d`.`t``x` (`name` varchar(8) CHARACTER SET utf8mb4 NULL DEFAULT '' COMMENT 'it''s', `id` bigint NOT NULL AUTO_INCREMENT, `at` datetime NULL DEFAULT CURRENT_TIMESTAMP, `n` int NULL DEFAULT 5, `e` int NULL DEFAULT (uuid()), "
        "PRIMARY KEY (`id`), UNIQUE KEY `uk` (`name`), FULLTEXT KEY `ft` (`name`), UNIQUE KEY `pre` (`name`(3))) DEFAULT CHARSET=utf8mb4 COMMENT='c'"
    )
    assert t.create_postgres(own, "s") == "CREATE TABLE \"s\".\"t`x\" (\"name\" VARCHAR(8) DEFAULT '', \"id\" BIGINT NOT NULL, \"at\" TIMESTAMP DEFAULT CURRENT_TIMESTAMP, \"n\" INTEGER DEFAULT 5, \"e\" INTEGER, PRIMARY KEY (\"id\"), UNIQUE (\"name\"))"
    doris = t.create_doris(own, "4", 1)
    assert doris.startswith("CREATE TABLE IF NOT EXISTS `d`.`t``x` (\n  `id` BIGINT NOT NULL,\n  `name` VARCHAR(24) NULL DEFAULT '' COMMENT 'it''s'") and "UNIQUE KEY(`id`)\nDISTRIBUTED BY HASH(`id`) BUCKETS 4" in doris and '"replication_num" = "1"' in doris
    for bad in (lambda: t.create_doris(Table("d", "t", own.columns)), lambda: t.create_doris(own, "x"), lambda: t.create_mysql(Table("d", "t")), lambda: t.create_doris(Table("d", "t", (Column("k", "text", False),), ("k",)))):
        with pytest.raises(SchemaError):
            bad()


def test_index_names_and_mappings():
    assert t.index_name("db", "t") == "db.t" and t.index_name("db", "t", "own") == "own"
    assert t.index_name("DB", "t").startswith("db.t-") and t.index_name("DB", "t") != t.index_name("Db", "t")
    assert t.index_name("_d", "t").startswith("cdc_d.t-") and len(t.index_name("d", "é" * 300)) == 255
    own = Table("d", "t", (Column("id", "int unsigned"), Column("at", "datetime"), Column("j", "json")))
    mapping = t.derive_mapping(own, {"id": {"type": "unsigned_long"}})
    assert mapping["id"] == {"type": "unsigned_long"} and t.mapping_conflicts(own, mapping) == {}
    assert set(t.mapping_conflicts(own, {"id": {"type": "integer"}, "at": {"type": "date"}})) == {"id", "at", "j"}
    assert t.mapping_conflict(Column("j", "json"), {"type": "object"}, "strict") and t.mapping_conflict(Column("a", "int"), {"type": "unsigned_long"})
    assert t.mapping_conflict(Column("a", "float"), {"type": "double"}) is None and t.mapping_conflict(Column("a", "text"), {"type": "keyword"}) is None
