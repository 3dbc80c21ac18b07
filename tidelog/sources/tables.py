"""Sources of tables and their changes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changelog import read_changes
from ..plans.schema import Column, Index, Table, describe, spark_type
from ..plans.selector import Selector
from .snapshot import jdbc_predicates, split_predicate


class Source(Protocol):
    """What the engine asks of a source."""

    def tables(self) -> list[tuple[str, str]]: ...
    def describe(self, database: str, table: str) -> Table: ...
    def read(self, database: str, table: str, key: str | None = None, splits: list[tuple[object, object]] | None = None) -> DataFrame: ...
    def changes(self, database: str, table: str) -> DataFrame | None: ...

    #: Whether a table is read in splits, so that a run goes on after the finished ones.
    by_split: bool

    def position(self) -> int:
        """A position that every table, as it is read now, holds all changes up to."""

    def end(self, changes: DataFrame) -> int | None:
        """The last position of these changes."""


def last_seq(changes: DataFrame) -> int | None:
    return changes.agg(F.max("seq")).first()[0]


def table_of_json(database: str, table: str, raw: dict) -> Table:
    """A table from ``{"columns": [{"name", "type", ...}], "primary_keys": [...], "indexes": [...]}``."""
    columns = tuple(Column(**c) for c in raw["columns"])
    indexes = tuple(Index(i["name"], tuple(i["columns"]), bool(i.get("unique", False))) for i in raw.get("indexes", ()))
    return Table(database, table, columns, tuple(raw.get("primary_keys", ())), indexes, raw.get("comment", ""))


@dataclass
class FolderSource:
    """Tables as ``<folder>/<database>/<table>.parquet``, changes as JSON lines under
    ``<folder>/<database>/<table>.changes``, source types and keys, where known, in ``<table>.schema.json``.

    ``seq`` is one order over all tables of the folder; the Parquet files are as of ``snapshot_position``.
    """

    spark: SparkSession
    folder: str
    names: list[tuple[str, str]]
    keys: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)
    snapshot_position: int = 0
    by_split: bool = False

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FolderSource:
        """All tables that the folder has."""
        own = cls(spark, folder.rstrip("/"), [])
        fs, path = own._fs(own.folder)
        found = fs.globStatus(path(f"{own.folder}/*/*.parquet")) or []
        own.names = sorted((f.getPath().getParent().getName(), f.getPath().getName().removesuffix(".parquet")) for f in found)
        return own

    def _fs(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def tables(self) -> list[tuple[str, str]]:
        return list(self.names)

    def position(self) -> int:
        return self.snapshot_position

    def end(self, changes: DataFrame) -> int | None:
        return last_seq(changes)

    def _sidecar(self, database: str, table: str) -> dict | None:
        at = f"{self.folder}/{database}/{table}.schema.json"
        fs, path = self._fs(at)
        if not fs.exists(path(at)):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(at, wholetext=True).collect()))

    def read(self, database: str, table: str, key: str | None = None, splits: list[tuple[object, object]] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{database}/{table}.parquet")
        if key and splits is not None:
            wanted = F.lit(False)
            for low, high in splits:
                wanted = wanted | split_predicate(key, low, high)
            rows = rows.where(wanted)
        return rows

    def describe(self, database: str, table: str) -> Table:
        raw = self._sidecar(database, table)
        if raw is not None:
            return table_of_json(database, table, raw)
        return describe(database, table, self.read(database, table).schema, self.keys.get((database, table), ()))

    def image_type(self, database: str, table: str) -> T.StructType:
        """The images' columns: those of the files, and what the source has added since."""
        kind = [T.StructField(f.name, f.dataType) for f in self.read(database, table).schema]
        there = {f.name.casefold() for f in kind}
        raw = self._sidecar(database, table)
        more = [] if raw is None else [T.StructField(c.name, spark_type(c.type)) for c in table_of_json(database, table, raw).columns if c.name.casefold() not in there]
        return T.StructType([*kind, *more])

    def changes(self, database: str, table: str) -> DataFrame | None:
        at = f"{self.folder}/{database}/{table}.changes"
        fs, path = self._fs(at)
        return read_changes(self.spark.read.text(at), self.image_type(database, table)) if fs.exists(path(at)) else None

    def stream(self, files_per_batch: int = 64) -> DataFrame:
        """Lines of all tables' changes, as they arrive."""
        return self.spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(f"{self.folder}/*/*.changes")


def table_from_catalog(database: str, table: str, columns: list[dict], indexes: list[dict], comment: str = "") -> Table:
    """A table from rows of a server's catalog: ``columns`` in order, ``indexes`` a row per index and column.

    Types stay the server's own text, so unsigned, enum, set and json are known downstream.
    """
    own = tuple(
        Column(c["name"], c["type"], c["nullable"] in ("YES", True), "auto_increment" in (c.get("extra") or "").lower(), c.get("default"), "default_generated" in (c.get("extra") or "").lower(), c.get("comment") or "", c.get("charset") or "", c.get("collation") or "")
        for c in columns
    )
    by_name: dict[str, list[dict]] = {}
    for i in sorted(indexes, key=lambda i: (i["name"], i["place"])):
        by_name.setdefault(i["name"], []).append(i)
    keys = tuple(i["column"] for i in by_name.pop("PRIMARY", []))
    more = tuple(Index(name, tuple(i["column"] for i in parts), not parts[0]["non_unique"], tuple(i.get("prefix") or 0 for i in parts), parts[0].get("type") or "BTREE") for name, parts in by_name.items())
    return Table(database, table, own, keys, more, comment)


#: The server's catalog, by the names above.
COLUMNS_SQL = """SELECT column_name AS name, column_type AS type, is_nullable AS nullable, extra AS extra, column_default AS `default`, column_comment AS comment, character_set_name AS charset, collation_name AS collation
FROM information_schema.columns WHERE table_schema = {database} AND table_name = {table} ORDER BY ordinal_position"""
INDEXES_SQL = """SELECT index_name AS name, seq_in_index AS place, column_name AS `column`, non_unique AS non_unique, sub_part AS prefix, index_type AS type
FROM information_schema.statistics WHERE table_schema = {database} AND table_name = {table}"""


@dataclass
class JdbcSource:
    """Tables of a database that Spark reads over JDBC, in splits.  Needs the database's driver; changes come from elsewhere."""

    spark: SparkSession
    url: str
    properties: dict[str, str]
    parallelism: int = 1
    by_split: bool = True

    def _query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.properties).load()

    def tables(self) -> list[tuple[str, str]]:
        return [tuple(r) for r in self._query("SELECT table_schema AS d, table_name AS t FROM information_schema.tables WHERE table_type = 'BASE TABLE'").collect()]

    def position(self) -> int:
        return 0

    def end(self, changes: DataFrame) -> int | None:
        return last_seq(changes)

    def describe(self, database: str, table: str) -> Table:
        text = {"database": "'" + database.replace("'", "''") + "'", "table": "'" + table.replace("'", "''") + "'"}
        columns, indexes = ([r.asDict() for r in self._query(sql.format(**text)).collect()] for sql in (COLUMNS_SQL, INDEXES_SQL))
        return table_from_catalog(database, table, columns, indexes)

    def image_type(self, database: str, table: str) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in self.describe(database, table).columns])

    def read(self, database: str, table: str, key: str | None = None, splits: list[tuple[object, object]] | None = None) -> DataFrame:
        """The table; with splits, a partition for each."""
        name = f"`{database}`.`{table}`"
        if not key or splits is None:
            return self.spark.read.jdbc(self.url, name, properties=self.properties)
        return self.spark.read.jdbc(self.url, name, predicates=jdbc_predicates(key, splits) or ["1 = 0"], properties=self.properties)

    def changes(self, database: str, table: str) -> DataFrame | None:
        return None


def selected(source: Source, selector: Selector) -> list[tuple[str, str]]:
    """The source's tables that are captured, by name."""
    return sorted(t for t in source.tables() if selector.matches(*t))
