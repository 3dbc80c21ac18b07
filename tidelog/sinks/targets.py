"""Targets: what a pipeline's sink does with prepared tables, batches of events and schema changes.

``open_target`` picks one by ``sink.type``.  The network lies behind ``Transports``, so each target runs against a fake as
it does against a server.
"""

from __future__ import annotations

import base64
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typemap import alter_postgres, create_doris, create_mysql, create_postgres, derive_mapping, doris_column, index_name, mapping_conflicts
from ..operators.apply import doris_violations
from ..operators.encode import ddl_envelope, elastic_operations, envelope, json_lines, kafka_records
from ..plans import ddl
from ..plans.config import Block
from ..plans.evolve import Applied, Refused, SchemaChangeError, check_keys, doris_target_problems, evolve_state, missing_columns, plan_change, postgres_target_problems
from ..plans.schema import Column, SchemaError, Table, parse_type, spark_type
from ..plans.selector import ConfigError
from ..streaming.tables import DELETED, VersionedTable
from . import writers


log_ = logging.getLogger("tidelog")


@dataclass
class SinkTable:
    """A table that is written, with the source tables that are routed into it."""

    database: str
    name: str
    table: Table  # what the target holds, under its own name
    sources: list[tuple[str, str]]
    routed: bool = False

    @property
    def id(self) -> str:
        return f"{self.database}.{self.name}"

    @property
    def keys(self) -> tuple[str, ...]:
        return self.table.primary_keys


@dataclass
class Transports:
    """Connections to sinks; those that are None are made from the settings."""

    connect: Callable[[], Any] | None = None
    place: str = "?"
    #: (schema, table) -> ({column: {type, nullable, default}}, keys), or None for a missing table.
    catalog: Callable[[str, str], tuple[dict, tuple] | None] | None = None
    post: writers.Post | None = None
    #: (method, url, body) -> (status, answer)
    request: Callable[[str, str, dict | None], tuple[int, dict]] | None = None
    #: (url, label, body) -> answer of a load
    put: Callable[[str, str, bytes], dict] | None = None
    load_state: Callable[[str], str] = lambda label: "UNAVAILABLE"
    kafka_format: str = "kafka"
    kafka_options: dict[str, str] = field(default_factory=dict)
    wait: float = 0.2


def now_ms() -> int:
    return int(time.time() * 1000)


class Target:
    """The base: prepares nothing, counts nothing, knows no batch."""

    def __init__(self, sink: Block, transports: Transports):
        self.sink, self.transports = sink, transports

    def prepare(self, own: SinkTable) -> None:
        """Once a run and table, before a row is written."""

    def applied(self, own: SinkTable) -> int | None:
        """The last batch that the target is known to hold."""
        return None

    def begin(self, own: SinkTable, batch: int) -> Any:
        """What the writes of a batch go through; None if the batch is there already."""
        return self

    def columns(self, own: SinkTable, handle: Any) -> set[str] | None:
        """Columns that the target has now, in folded case; None if it doesn't matter or isn't known."""
        return None

    def write(self, own: SinkTable, handle: Any, log: DataFrame, batch: int) -> None:
        raise NotImplementedError

    def change(self, own: SinkTable, handle: Any, statement: dict, change: ddl.Change, definitions: dict[str, Column]) -> None:
        raise SchemaChangeError(f"{own.id}: {change.sql}")

    def commit(self, own: SinkTable, handle: Any) -> None:
        """The batch is there in full."""

    def plan(self, own: SinkTable, change: ddl.Change, definitions: dict[str, Column]) -> Table | None:
        """The table after a column change; None if there is nothing to do."""
        plan = plan_change(own.table, change, definitions)
        if isinstance(plan, Refused):
            raise SchemaChangeError(f"{own.id}: {change.sql}: {plan.reason}")
        return plan.table if isinstance(plan, Applied) else None


class FolderTarget(Target):
    """Versioned tables under a folder, in place of the live sink, with the policy of its type."""

    def __init__(self, spark: SparkSession, folder: str, sink: Block, transports: Transports):
        super().__init__(sink, transports)
        self.spark, self.folder = spark, folder.rstrip("/")

    def stored(self, own: SinkTable) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/{own.id}", own.keys)

    def applied(self, own: SinkTable) -> int | None:
        return self.stored(own).batch()

    def begin(self, own: SinkTable, batch: int) -> Any:
        return self.stored(own).begin(batch)

    def columns(self, own: SinkTable, handle: Any) -> set[str] | None:
        return None if handle.schema is None else {c.casefold() for c in handle.schema.names}

    def write(self, own: SinkTable, handle: Any, log: DataFrame, batch: int) -> None:
        last = writers.reduced(log, own.keys)
        if handle.schema is None:  # the first rows are the base: what a log leaves behind
            handle.replace(last.where(~F.col("deleted")).select("row.*"))
        else:
            handle.append(last.select("row.*", F.col("deleted").alias(DELETED)))

    def change(self, own: SinkTable, handle: Any, statement: dict, change: ddl.Change, definitions: dict[str, Column]) -> None:
        if change.action in (ddl.TRUNCATE, ddl.DROP_TABLE):
            handle.truncate()
            return
        if handle.schema is None:
            own.table = self.plan(own, change, definitions) or own.table
            return
        there = {c.casefold() for c in handle.schema.names}
        own.table = replace(own.table, columns=tuple(c for c in own.table.columns if c.name.casefold() in there))
        after = self.plan(own, change, definitions)
        if after is None:
            return
        kinds = {c: f.dataType for c, f in zip((n.casefold() for n in handle.schema.names), handle.schema)}
        if change.action in (ddl.ADD_COLUMN, ddl.DROP_COLUMN):
            names = [n for n in handle.schema.names if after.column(n)]
            new = [c for c in after.columns if c.name.casefold() not in there]
            if any(c.default_is_expression for c in new):
                raise SchemaChangeError(f"{own.id}: {change.sql}: a computed default")
            fields = [T.StructField(n, kinds[n.casefold()]) for n in names] + [T.StructField(c.name, spark_type(c.type)) for c in new]
            handle.evolve(T.StructType(fields), {c.name: c.default for c in new})
        else:
            handle.replace(evolve_state(handle.read(), change, after))
        own.table = after

    def commit(self, own: SinkTable, handle: Any) -> None:
        handle.publish()


def in_order(log: DataFrame) -> DataFrame:
    return log.orderBy("seq")


class StdoutTarget(Target):
    """Envelopes, one a line, in order."""

    def write(self, own: SinkTable, handle: Any, log: DataFrame, batch: int) -> None:
        writers.print_lines(envelope(in_order(log), now_ms()))

    def change(self, own: SinkTable, handle: Any, statement: dict, change: ddl.Change, definitions: dict[str, Column]) -> None:
        writers.print_lines(ddl_rows(statement))


STATEMENT = "seq long, source_db string, source_table string, source_ts_ms long, ddl string"


def ddl_rows(statement: dict, name: str = "mysql_binlog_source") -> DataFrame:
    spark = SparkSession.getActiveSession()
    return ddl_envelope(spark.createDataFrame([tuple(statement[x] for x in ("seq", "source_db", "source_table", "source_ts_ms", "ddl"))], STATEMENT), now_ms(), name)


class KafkaTarget(Target):
    def _send(self, records: DataFrame) -> None:
        s = self.sink
        writers.write_kafka(records, s.brokers, s.get("client_id", ""), s.producer_bytes, s.flush_timeout, self.transports.kafka_format, self.transports.kafka_options)

    def write(self, own: SinkTable, handle: Any, log: DataFrame, batch: int) -> None:
        self._send(kafka_records(log, own.keys, self.sink.topic, now_ms(), self.sink.source_name))

    def change(self, own: SinkTable, handle: Any, statement: dict, change: ddl.Change, definitions: dict[str, Column]) -> None:
        rows = ddl_rows(statement, self.sink.source_name)
        topic = own.id if own.id != f"{statement['source_db']}.{statement['source_table']}" else self.sink.topic
        self._send(rows.select("seq", F.lit(topic).alias("topic"), F.lit(None).cast("string").alias("key"), "value"))


class SqlTarget(Target):
    """MySQL or PostgreSQL: the last write of each key of a batch; a table is made if it may be, and held against its definition."""

    @property
    def dialect(self) -> str:
        return self.sink.type

    def connect(self) -> Callable[[], Any]:
        if self.transports.connect is None:
            self.transports.connect, self.transports.place = default_connect(self.sink)
        return self.transports.connect

    def execute(self, *statements: str) -> None:
        connection = self.connect()()
        try:
            for sql in statements:
                connection.cursor().execute(sql)
            connection.commit()
        finally:
            connection.close()

    def where(self, own: SinkTable) -> str:
        """The schema or database that the table is in."""
        if self.dialect == "postgresql":
            return own.database if own.routed else self.sink.schema
        return own.database

    def prepare(self, own: SinkTable) -> None:
        if self.dialect == "mysql":
            if self.sink.auto_create:
                try:  # a table that can't be made fails when it is written
                    self.execute(create_mysql(own.table))
                except Exception as e:
                    log_.warning("%s was not created: %s", own.id, e)
            return
        schema = self.where(own)
        look = self.transports.catalog or default_catalog(self.connect(), self.transports)
        there = look(schema, own.name)
        if there is None:
            if not self.sink.auto_create:
                raise SchemaError(f"postgresql: {schema}.{own.name} does not exist")
            self.execute(create_postgres(own.table, schema))
        elif problems := postgres_target_problems(own.table, *there):
            raise SchemaError(f"postgresql: {schema}.{own.name}: {'; '.join(problems)}")

    def write(self, own: SinkTable, handle: Any, log: DataFrame, batch: int) -> None:
        writers.write_log(log, self.connect(), self.dialect, self.where(own), own.name, own.keys, self.sink.batch_size, self.sink.max_retries, self.transports.place)

    def change(self, own: SinkTable, handle: Any, statement: dict, change: ddl.Change, definitions: dict[str, Column]) -> None:
        if self.dialect == "mysql":
            self.execute(ddl.rewrite_table(change.sql, own.database, own.name))
            after = plan_change(own.table, change, definitions)
            own.table = after.table if isinstance(after, Applied) else own.table
            return
        schema = self.where(own)
        if change.action == ddl.TRUNCATE:
            self.execute(f"TRUNCATE TABLE {ddl.quote(schema, chr(34))}.{ddl.quote(own.name, chr(34))}")
        elif change.action == ddl.DROP_TABLE:
            self.execute(f"DROP TABLE IF EXISTS {ddl.quote(schema, chr(34))}.{ddl.quote(own.name, chr(34))}")
        elif after := self.plan(own, change, definitions):
            self.execute(*alter_postgres(own.table, after, change, schema))
            own.table = after


class DorisTarget(SqlTarget):
    """Stream loads of complete after images into a table with a unique key."""

    def prepare(self, own: SinkTable) -> None:
        if not own.keys:
            raise SchemaError(f"doris: table {own.id} has no primary key")
        if self.sink.auto_create:
            self.execute(create_doris(own.table, self.sink.buckets, self.sink.replication))
        look = self.transports.catalog or default_catalog(self.connect(), self.transports)
        there = look(own.database, own.name)
        if there is None:
            raise SchemaError(f"doris: {own.id} does not exist")
        columns, keys = there
        new = missing_columns(own.table, columns, self.sink.schema_change)
        for c in new:
            self.execute(f"ALTER TABLE {ddl.quote(own.database)}.{ddl.quote(own.name)} ADD COLUMN {doris_column(c)}")
        rest = replace(own.table, columns=tuple(c for c in own.table.columns if c not in new))
        if problems := doris_target_problems(rest, columns, keys):
            raise SchemaError(f"doris: {own.id}: {'; '.join(problems)}")

    def write(self, own: SinkTable, handle: Any, log: DataFrame, batch: int) -> None:
        check_keys(own.table, own.keys)
        names = tuple(c.name for c in own.table.columns)
        bad = doris_violations(log, own.keys, names).select("reason", "seq").head(1)
        if bad:
            raise SchemaError(f"doris: {own.id}: event {bad[0]['seq']}: {bad[0]['reason']}")
        last = writers.reduced(log, own.keys).select(F.col("row").alias("after"), F.lit(0).cast("long").alias("seq"))
        shown = tuple(n for n in names if n in last.schema["after"].dataType.names)
        rows = json_lines(last, shown, tuple(c.name for c in own.table.columns if parse_type(c.type).base == "json"))
        url = f"http://{self.sink.hostname}:{self.sink.port}/api/{own.database}/{own.name}/_stream_load"
        send = self.transports.put or default_put(self.sink)
        writers.write_stream_load(rows, own.database, own.name, f"{batch:x}", batch, lambda label, body: send(url, label, body), self.sink.max_retries, self.transports.load_state, self.transports.wait)

    def change(self, own: SinkTable, handle: Any, statement: dict, change: ddl.Change, definitions: dict[str, Column]) -> None:
        after = self.plan(own, change, definitions)
        if after is not None:
            for c in after.columns:
                if own.table.column(c.name) is None:
                    self.execute(f"ALTER TABLE {ddl.quote(own.database)}.{ddl.quote(own.name)} ADD COLUMN {doris_column(c)}")
            own.table = after


class ElasticTarget(Target):
    """Documents under stable ids; an index is made, or held against the mapping, before rows are written."""

    def headers(self) -> dict:
        if not self.sink.get("username"):
            return {}
        pair = f"{self.sink.username}:{self.sink.password}".encode()
        return {"Authorization": "Basic " + base64.b64encode(pair).decode()}

    def request(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        url = f"{self.sink.hosts[0].rstrip('/')}/{path}"
        if self.transports.request:
            return self.transports.request(method, url, body)
        return writers.http_post(url, json.dumps(body).encode() if body else b"", {"Content-Type": "application/json"} | self.headers(), method, self.sink.request_timeout)

    def index(self, own: SinkTable) -> str:
        return index_name(own.database, own.name, self.sink.index_name)

    def prepare(self, own: SinkTable) -> None:
        if not own.keys:
            raise SchemaError(f"elasticsearch: table {own.id} has no primary key")
        index = self.index(own)
        status, answer = self.request("GET", f"{index}/_mapping")
        if status == 404:
            if not self.sink.auto_create:
                raise SchemaError(f"elasticsearch: index {index} does not exist")
            overrides = (self.sink.get("mapping") or {}).get("properties", {})
            status, answer = self.request("PUT", index, {"mappings": {"dynamic": "strict", "properties": derive_mapping(own.table, overrides)}})
            if not 200 <= status < 300:
                raise SchemaError(f"elasticsearch: index {index} was not created: {answer}")
            return
        mappings = answer.get(index, {}).get("mappings", {})
        if problems := mapping_conflicts(own.table, mappings.get("properties", {}), str(mappings.get("dynamic", ""))):
            raise SchemaError(f"elasticsearch: index {index}: {problems}")

    def write(self, own: SinkTable, handle: Any, log: DataFrame, batch: int) -> None:
        operations = elastic_operations(log, own.table, self.index(own))
        post = self.transports.post or writers.http_post
        writers.write_bulk(operations, self.sink.hosts[0].rstrip("/"), self.headers(), self.sink.bulk_bytes, self.sink.max_retries, post, self.transports.wait)


def default_connect(sink: Block) -> tuple[Callable[[], Any], str]:
    """A connection to the server by whichever driver is installed, and its place holder."""
    names = ("psycopg", "psycopg2") if sink.type == "postgresql" else ("pymysql", "MySQLdb")
    port = sink.get("sql_port") if sink.type == "doris" else sink.port
    database = {"dbname": sink.database} if sink.type == "postgresql" else {}
    for name in names:
        try:
            __import__(name)
        except ImportError:
            continue
        options = {"host": sink.hostname, "port": port, "user": sink.username, "password": sink.get("password", "")} | database

        def connect(name=name, options=options):
            return __import__(name).connect(**options)

        return connect, "%s"
    raise ConfigError("sink.type", f"{sink.type} needs one of the packages {', '.join(names)}")


#: Columns and keys of a table in the servers' catalogs.
TARGET_COLUMNS = "SELECT column_name, {type}, is_nullable, column_default FROM information_schema.columns WHERE table_schema = %s AND table_name = %s ORDER BY ordinal_position"
TARGET_KEYS = "SELECT k.column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k USING (constraint_schema, constraint_name, table_schema, table_name) WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = %s AND c.table_name = %s ORDER BY k.ordinal_position"
POSTGRES_FORM = "CASE data_type WHEN 'character varying' THEN 'VARCHAR(' || character_maximum_length || ')' WHEN 'character' THEN 'CHAR(' || character_maximum_length || ')' WHEN 'numeric' THEN 'NUMERIC(' || numeric_precision || ',' || numeric_scale || ')' WHEN 'timestamp without time zone' THEN 'TIMESTAMP(' || datetime_precision || ')' ELSE upper(data_type) END"


def default_catalog(connect: Callable[[], Any], transports: Transports) -> Callable[[str, str], tuple[dict, tuple] | None]:
    """Looks a target's table up on its server."""

    def look(schema: str, table: str) -> tuple[dict, tuple] | None:
        connection = connect()
        try:
            cursor = connection.cursor()
            postgres = "psycopg" in type(connection).__module__
            cursor.execute(TARGET_COLUMNS.format(type=POSTGRES_FORM if postgres else "column_type"), (schema, table))
            columns = {n: {"type": k.upper(), "nullable": x == "YES", "default": d is not None} for n, k, x, d in cursor.fetchall()}
            if not columns:
                return None
            if postgres:
                cursor.execute(TARGET_KEYS, (schema, table))
            else:
                cursor.execute("SELECT column_name FROM information_schema.columns WHERE table_schema = %s AND table_name = %s AND column_key <> '' ORDER BY ordinal_position", (schema, table))
            return columns, tuple(r[0] for r in cursor.fetchall())
        finally:
            connection.close()

    return look


def default_put(sink: Block) -> Callable[[str, str, bytes], dict]:
    pair = base64.b64encode(f"{sink.username}:{sink.get('password', '')}".encode()).decode()
    timeout = sink.request_timeout

    def put(url: str, label: str, body: bytes) -> dict:
        headers = {"Authorization": f"Basic {pair}", "Expect": "100-continue", "label": label, "format": "json", "read_json_by_line": "true", "strict_mode": "true", "max_filter_ratio": "0"}
        try:
            return writers.http_post(url, body, headers, "PUT", timeout)[1]
        except OSError:  # whether it arrived is looked up by the label
            return {}

    return put


TARGETS = {"stdout": StdoutTarget, "kafka": KafkaTarget, "mysql": SqlTarget, "postgresql": SqlTarget, "doris": DorisTarget, "elasticsearch": ElasticTarget}


def open_target(spark: SparkSession, sink: Block, folder: str = "", transports: Transports | None = None) -> Target:
    """The target of the settings; with a folder, tables of rows go there instead of to a server."""
    transports = transports or Transports()
    if folder and sink.type not in ("stdout", "kafka"):
        return FolderTarget(spark, folder, sink, transports)
    return TARGETS[sink.type](sink, transports)
