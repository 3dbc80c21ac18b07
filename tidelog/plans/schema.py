"""Tables, columns and indexes as the driver knows them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # the source's type text
    nullable: bool = True
    auto_increment: bool = False
    default: str | None = None
    default_is_expression: bool = False
    comment: str = ""
    charset: str = ""
    collation: str = ""


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    prefixes: tuple[int, ...] = ()
    type: str = "BTREE"


@dataclass(frozen=True)
class Table:
    database: str
    table: str
    columns: tuple[Column, ...] = ()
    primary_keys: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()
    comment: str = ""
    charset: str = ""
    collation: str = ""

    @property
    def id(self) -> str:
        return f"{self.database}.{self.table}"

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None) or next((c for c in self.columns if c.name.casefold() == name.casefold()), None)


class SchemaError(ValueError):
    """A table can't be captured or written as asked."""


@dataclass(frozen=True)
class ColumnType:
    """A type text taken apart: ``decimal(10,2) unsigned`` and the like."""

    base: str
    args: tuple[int, ...] = ()
    unsigned: bool = False
    labels: tuple[str, ...] = field(default=())


def parse_type(text: str) -> ColumnType:
    m = re.match(r"\s*([A-Za-z]+)\s*(?:\((.*)\))?\s*(.*)$", text, re.S)
    if not m:
        raise SchemaError(f"type {text!r} is empty")
    base, inner, rest = m[1].lower(), m[2], m[3].lower()
    if base in ("enum", "set"):
        return ColumnType(base, labels=tuple(x.replace("''", "'").replace("\\\\", "\\") for x in re.findall(r"'((?:[^']|'')*)'", inner or "")))
    return ColumnType(base, tuple(int(x) for x in re.findall(r"\d+", inner or "")), "unsigned" in rest)


#: Spark types of source types; the value shapes downstream.
INTEGERS = {"tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint", "bool": "tinyint", "boolean": "tinyint"}
WIDER = {"tinyint": "smallint", "smallint": "int", "mediumint": "int", "int": "bigint", "integer": "bigint", "bigint": "decimal(20,0)"}
TEXTS = ("char", "varchar", "tinytext", "text", "mediumtext", "longtext", "json", "enum", "set", "time")
BYTES = ("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob")


def spark_type(text: str) -> T.DataType:
    """The Spark type that a captured column has.  ``vector`` and unknown types raise."""
    t = parse_type(text)
    if t.base in INTEGERS:
        name = WIDER[t.base] if t.unsigned and t.base in WIDER else INTEGERS[t.base]
    elif t.base in ("decimal", "numeric", "dec", "fixed"):
        p, s = (*t.args, *(10, 0)[len(t.args) :])
        if p > 38:
            raise SchemaError(f"type {text!r} has more than 38 digits")
        name = f"decimal({p},{s})"
    elif t.base in ("float", "double", "real", "date"):
        name = {"real": "double"}.get(t.base, t.base)
    elif t.base in ("datetime", "timestamp"):
        name = "timestamp_ntz"
    elif t.base == "year":
        name = "smallint"
    elif t.base in TEXTS:
        name = "string"
    elif t.base in BYTES:
        name = "binary"
    elif t.base == "bit":
        name = "bigint"
    else:
        raise SchemaError(f"type {text!r} is not supported")
    return T.DataType.fromDDL(name)


SOURCE_TYPES = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint", "float": "float", "double": "double", "string": "text", "binary": "blob", "date": "date", "timestamp_ntz": "datetime(6)", "timestamp": "timestamp(6)", "boolean": "tinyint(1)"}


def describe(database: str, table: str, schema: T.StructType, primary_keys: tuple[str, ...] = ()) -> Table:
    """The table that a DataFrame's schema stands for; metadata ``mysql_type`` wins."""
    columns = []
    for f in schema:
        kind = f.metadata.get("mysql_type") or (f"decimal({f.dataType.precision},{f.dataType.scale})" if isinstance(f.dataType, T.DecimalType) else SOURCE_TYPES.get(f.dataType.typeName()))
        if kind is None:
            raise SchemaError(f"{database}.{table}: column {f.name} has no source type")
        columns.append(Column(f.name, kind, f.nullable and f.name not in primary_keys))
    return Table(database, table, tuple(columns), tuple(primary_keys))


def project_table(table: Table, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> Table:
    """The table under a projection: keys that aren't projected go, and indexes of columns that go.

    No ``columns`` keep all; unknown ones raise.  ``keys`` replace the primary key.
    """
    if columns:
        missing = [c for c in columns if table.column(c) is None]
        if missing:
            raise SchemaError(f"{table.id}: projected column {missing[0]} does not exist")
        folded = {c.casefold() for c in columns}
        table = replace(
            table,
            columns=tuple(replace(table.column(c), name=c) for c in columns),
            primary_keys=tuple(k for k in table.primary_keys if k.casefold() in folded),
            indexes=tuple(i for i in table.indexes if all(c.casefold() in folded for c in i.columns)),
        )
    return replace(table, primary_keys=tuple(keys)) if keys else table


#: Types whose columns can split a snapshot.
CHUNK_TYPES = ("tinyint", "smallint", "int", "integer", "bigint", "decimal", "numeric", "char", "varchar", "date", "time", "datetime", "timestamp")


def chunk_column(table: Table, configured: str = "") -> str:
    """The configured column, else the first of the primary key; it must order and not be null."""
    name = configured or (table.primary_keys[0] if table.primary_keys else "")
    if not name:
        raise SchemaError(f"{table.id}: no primary key to split by; name a chunk key column")
    column = table.column(name)
    if column is None:
        raise SchemaError(f"{table.id}: chunk key column {name} does not exist")
    if parse_type(column.type).base not in CHUNK_TYPES:
        raise SchemaError(f"{table.id}: chunk key column {name} has type {column.type}, which does not split")
    if column.nullable:
        raise SchemaError(f"{table.id}: chunk key column {name} may be null")
    return column.name
