"""Encoders: change events as what each kind of sink takes.

Every encoder is a projection, so it streams, and its rows can go to any writer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical
from ..plans.ddl import quote
from ..plans.schema import SchemaError, Table, parse_type
from .apply import key_changed
from .changelog import image_type

# --- JSON envelope and Kafka ------------------------------------------------------------


def json_image(side: str, kind: T.StructType) -> Column:
    """An image with its fields by name; decimals keep their digits, bytes are base64."""
    fields = [F.col(f"{side}.`{n}`").alias(n) for n in sorted(kind.fieldNames())]
    return F.when(F.col(side).isNotNull(), F.struct(*fields))


def envelope(log: DataFrame, ts_ms: int | Column, name: str = "mysql_binlog_source", version: str = "1", connector: str = "mysql") -> DataFrame:
    """The log with ``value``: ``{before, after, source, op, ts_ms}`` as JSON, nulls kept.

    ``ts_ms`` is the time of encoding.  ``source`` names the captured table, not the routed one,
    and its time is null where it isn't known.
    """
    kind = image_type(log)
    source = F.struct(
        F.lit(version).alias("version"), F.lit(connector).alias("connector"), F.lit(name).alias("name"),
        F.when(F.col("source_ts_ms") != 0, F.col("source_ts_ms")).alias("ts_ms"), F.col("source_db").alias("db"), F.col("source_table").alias("table"),
    )
    op = F.when(F.col("op").isin("r", "c", "u", "d"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.col("op"))))
    before = F.when(F.col("op").isin("u", "d"), json_image("before", kind))
    after = F.when(F.col("op") != "d", json_image("after", kind))
    at = F.lit(ts_ms).cast("long") if isinstance(ts_ms, int) else ts_ms
    body = F.struct(before.alias("before"), after.alias("after"), source.alias("source"), op.alias("op"), at.alias("ts_ms"))
    return log.withColumn("value", F.to_json(body, {"ignoreNullFields": "false"}))


def ddl_envelope(statements: DataFrame, ts_ms: int, name: str = "mysql_binlog_source", version: str = "1", connector: str = "mysql") -> DataFrame:
    """``source_db, source_table, source_ts_ms, ddl`` with ``value``: an envelope without images."""
    none = F.lit(None).cast("string")
    source = F.struct(F.lit(version).alias("version"), F.lit(connector).alias("connector"), F.lit(name).alias("name"), F.when(F.col("source_ts_ms") != 0, F.col("source_ts_ms")).alias("ts_ms"), F.col("source_db").alias("db"), F.col("source_table").alias("table"))
    body = F.struct(none.alias("before"), none.alias("after"), source.alias("source"), F.lit("ddl").alias("op"), F.lit(ts_ms).cast("long").alias("ts_ms"), F.col("ddl"))
    return statements.withColumn("value", F.to_json(body, {"ignoreNullFields": "false"}))


def topic(default: str) -> Column:
    """The routed table's name where routing changed it, else the default topic."""
    if any(c.isspace() for c in default) or not default:
        raise ValueError("a topic has no white space")
    sink, source = (F.concat_ws(".", f"{x}_db", f"{x}_table") for x in ("sink", "source"))
    return F.when(sink.rlike(r"\s"), F.raise_error(F.concat(F.lit("topic has white space: "), sink))).when(sink != source, sink).otherwise(F.lit(default))


def json_scalar(value: Column, kind: T.DataType) -> Column:
    """A key's value in JSON; null is the empty text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType)):
        text = value.cast("string")
    else:
        # one-field object, cut out of its JSON: the writer does the escaping
        body = F.to_json(F.struct(value.cast("string").alias("k") if not isinstance(kind, T.BinaryType) else value.alias("k")))
        text = F.regexp_extract(body, r'^\{"k":(.*)\}\z', 1)
    return F.when(value.isNotNull(), text).otherwise(F.lit('""'))


def message_key(log: DataFrame, keys: tuple[str, ...]) -> Column:
    """A JSON array of the key's values in key order, of the after image, or of a delete's before;
    null without keys."""
    if not keys:
        return F.lit(None).cast("string")
    kind = image_type(log)
    part = lambda side: F.concat(F.lit("["), F.concat_ws(",", *(json_scalar(F.col(f"{side}.`{k}`"), kind[k].dataType) for k in keys)), F.lit("]"))
    return F.when(F.col("op") == "d", part("before")).otherwise(part("after"))


def kafka_records(log: DataFrame, keys: tuple[str, ...], default_topic: str, ts_ms: int, name: str = "mysql_binlog_source") -> DataFrame:
    """``topic, key, value`` of routed events, and ``seq``, as the Kafka writer takes them."""
    return envelope(log, ts_ms, name).select(topic(default_topic).alias("topic"), message_key(log, keys).alias("key"), "value", "seq")


# --- Elasticsearch ------------------------------------------------------------------------


INTEGER_TYPES = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "bool", "boolean")


def canonical_value(value: Column, mysql_type: str, kind: T.DataType) -> Column:
    """The value's canonical text by its source type; what ids and documents are made of."""
    t = parse_type(mysql_type)
    number = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    # Typed values need no parsing.
    if isinstance(kind, T.DateType):
        return value.cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if t.base in INTEGER_TYPES and (number or (isinstance(kind, T.DecimalType) and kind.scale == 0)):
        text = value.cast("string")
        return F.when(value < 0, F.raise_error(F.concat(F.lit("negative: "), text)).cast("string")).otherwise(text) if t.unsigned else text
    forms: dict[str, Callable[[], Column]] = {
        "date": lambda: canonical.date(value), "datetime": lambda: canonical.datetime(value), "timestamp": lambda: canonical.datetime(value),
        "time": lambda: canonical.time(value), "year": lambda: canonical.year(value), "json": lambda: canonical.json(value),
        "enum": lambda: canonical.enum(value, t.labels, number), "set": lambda: canonical.set_(value, t.labels, number),
        "float": lambda: canonical.floating(value, "float"), "double": lambda: canonical.floating(value), "real": lambda: canonical.floating(value),
    }
    if t.base in forms:
        return forms[t.base]()
    if t.base in ("decimal", "numeric", "dec", "fixed"):
        return canonical.decimal(value, t.args[1] if len(t.args) > 1 else 0)
    if t.base in INTEGER_TYPES:
        return canonical.unsigned(value) if t.unsigned else canonical.integer(value)
    if isinstance(kind, T.BinaryType):
        return canonical.binary(value)
    return value.cast("string")


def document_id(table: Table, side: str, kind: T.StructType) -> Column:
    if not table.primary_keys:
        raise SchemaError(f"elasticsearch: table {table.id} has no primary key")
    return canonical.document_id(table.id, [(k, canonical_value(F.col(f"{side}.`{k}`"), table.column(k).type, kind[k].dataType)) for k in table.primary_keys])


def document(table: Table, side: str, kind: T.StructType, zone: str = "UTC") -> Column:
    """A row as a JSON document; only here are TIMESTAMPs moved to UTC."""
    fields = []
    for c in sorted(table.columns, key=lambda c: c.name):
        value, t, own = F.col(f"{side}.`{c.name}`"), parse_type(c.type), kind[c.name].dataType
        if t.base == "timestamp":
            out = canonical.timestamp_utc(value, zone)
        elif isinstance(own, T.DecimalType) and t.base == "bigint" or isinstance(own, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and t.base not in ("year", "enum", "set"):
            out = value  # JSON numbers
        elif t.base in ("float", "double", "real"):
            out = value.cast("float" if t.base == "float" else "double")
        elif t.base == "json":
            out = F.try_parse_json(canonical.json(value))
        else:
            out = canonical_value(value, c.type, own)
        fields.append(out.alias(c.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def elastic_operations(log: DataFrame, table: Table, index: str, zone: str = "UTC", delete_old_key: bool = True) -> DataFrame:
    """``seq, sub_seq, action, index, id, document``: index operations, and deletes by id.

    An update that changes the key deletes the old document first; ``delete_old_key=False``
    leaves it behind.
    """
    kind = image_type(log)
    entry = lambda action, side, sub, body: F.struct(F.lit(sub).alias("sub_seq"), F.lit(action).alias("action"), document_id(table, side, kind).alias("id"), body.alias("document"))
    put = entry("index", "after", 1, document(table, "after", kind, zone))
    cut = entry("delete", "before", 0, F.lit(None).cast("string"))
    moved = (F.col("op") == "u") & key_changed(table.primary_keys) if delete_old_key else F.lit(False)
    ops = F.when(F.col("op") == "d", F.array(cut)).when(moved, F.array(cut, put)).otherwise(F.array(put))
    return log.select("seq", F.explode(ops).alias("o")).select("seq", "o.sub_seq", "o.action", F.lit(index).alias("index"), "o.id", "o.document")


def last_operations(operations: DataFrame) -> DataFrame:
    """One operation per index and id, so a bulk request never names a document twice."""
    best = F.max_by(F.struct("action", "document"), F.col("seq") * 2 + F.col("sub_seq")).alias("o")
    return operations.groupBy("index", "id").agg(best).select("index", "id", "o.*")


def bulk_lines(operations: DataFrame) -> DataFrame:
    """``lines, n_bytes``: the request body of each operation."""
    head = F.to_json(F.struct(F.struct(F.col("index").alias("_index"), F.col("id").alias("_id")).alias("x")))
    head = F.concat(F.lit('{"'), F.col("action"), F.substring(head, 4, 1_000_000))
    lines = F.when(F.col("action") == "delete", F.concat(head, F.lit("\n"))).otherwise(F.concat(head, F.lit("\n"), F.col("document"), F.lit("\n")))
    return operations.withColumn("lines", lines).withColumn("n_bytes", F.octet_length("lines"))


def split_bulk(lines: list[str], most: int) -> list[str]:
    """Request bodies of at most ``most`` bytes; a longer line raises.  For one task's lines."""
    out: list[list[str]] = [[]]
    size = 0
    for line in lines:
        n = len(line.encode())
        if n > most:
            raise ValueError(f"an operation has {n} bytes, more than {most}")
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(line)
        size += n
    return ["".join(x) for x in out if x]


#: Answers that are worth another try.
RETRYABLE_STATUS = (429, 500, 502, 503, 504)


def bulk_item(action: str, status: int) -> str:
    """``ok``, ``retry`` or ``fail`` for one item of a bulk response."""
    if 200 <= status < 300 or (action == "delete" and status == 404):
        return "ok"
    return "retry" if status in RETRYABLE_STATUS else "fail"


# --- JSON lines (stream load) --------------------------------------------------------------


def json_lines(log: DataFrame, columns: tuple[str, ...], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """``seq, value``: complete after images as JSON objects, nulls kept.

    Bytes must be text, JSON columns valid; the images of deletes have no place here.
    """
    kind = image_type(log)
    missing = [c for c in columns if c not in kind.fieldNames()]
    if missing:
        raise SchemaError(f"column {missing[0]} is not in the image")

    def field(name: str) -> Column:
        value, own = F.col(f"after.`{name}`"), kind[name].dataType
        if isinstance(own, T.BinaryType):
            value = F.when(value.isNotNull(), F.coalesce(F.try_validate_utf8(value.cast("string")), F.raise_error(F.lit(f"column {name} is no text"))))
        if isinstance(own, T.TimestampNTZType):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return (canonical.json(value) if name in json_columns else value).alias(name)

    whole = F.when(F.col("after").isNull(), F.raise_error(F.lit("no after image"))).otherwise(F.to_json(F.struct(*map(field, columns)), {"ignoreNullFields": "false"}))
    return log.select("seq", whole.alias("value"))


def load_label(table: str, nonce: str, batch: int, prefix: str = "tidelog") -> str:
    """A label that a replayed batch gets again: prefix, FNV-1a hash of the table, nonce, batch."""
    h = 0xCBF29CE484222325
    for b in table.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{prefix}_{h:016x}_{nonce}_{batch}"


def load_outcome(response: dict | None, label: str, sent: int) -> str:
    """``success``, ``retryable``, ``fatal``, ``unknown`` or ``label-exists`` for a load's answer.

    Rows that were filtered, or counts that differ from what was sent, are fatal.
    """
    if not response or response.get("Label") not in (None, "", label):
        return "unknown"
    status, total, loaded = response.get("Status"), response.get("NumberTotalRows"), response.get("NumberLoadedRows")
    if status == "Label Already Exists":
        state = (response.get("ExistingJobStatus") or "").strip().upper()
        return {"FINISHED": "success", "RUNNING": "label-exists", "": "unknown"}.get(state, "fatal")
    if status == "Fail":
        return "fatal"
    if status not in ("Success", "Publish Timeout"):
        return "unknown"
    known = status == "Success"  # a timeout may leave counts out
    if response.get("NumberFilteredRows") or (sent and (total is None and known or total not in (None, sent))):
        return "fatal"
    if sent and loaded not in (None, sent) or total and loaded != total and (loaded is not None or known):
        return "fatal"
    return "success"


# --- SQL statements -------------------------------------------------------------------------


def upsert_sql(dialect: str, database: str, table: str, columns: tuple[str, ...], keys: tuple[str, ...]) -> str:
    """The write of one row, with place holders in order of the columns."""
    if dialect == "mysql":
        names = [quote(c) for c in columns]
        return f"INSERT INTO {quote(database)}.{quote(table)} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))}) ON DUPLICATE KEY UPDATE {', '.join(f'{n}=VALUES({n})' for n in names)}"
    names = [quote(c, '"') for c in columns]
    sql = f'INSERT INTO {quote(database, chr(34))}.{quote(table, chr(34))} ({", ".join(names)}) VALUES ({", ".join(f"${i}" for i in range(1, len(names) + 1))})'
    if not keys:
        return sql
    if missing := [k for k in keys if k not in columns]:
        raise SchemaError(f"conflict key {missing[0]} is not written")
    others = [quote(c, '"') for c in columns if c not in keys]
    then = f"DO UPDATE SET {', '.join(f'{n} = EXCLUDED.{n}' for n in others)}" if others else "DO NOTHING"
    return f"{sql} ON CONFLICT ({', '.join(quote(k, chr(34)) for k in keys)}) {then}"


def delete_sql(dialect: str, database: str, table: str, keys: tuple[str, ...]) -> str:
    if not keys:
        raise SchemaError(f"{dialect}: {database}.{table} has no key for delete")
    if dialect == "mysql":
        return f"DELETE FROM {quote(database)}.{quote(table)} WHERE {' AND '.join(f'{quote(k)}=?' for k in keys)}"
    return f'DELETE FROM {quote(database, chr(34))}.{quote(table, chr(34))} WHERE {" AND ".join(f"{quote(k, chr(34))} = ${i}" for i, k in enumerate(keys, 1))}'


def target_of(event_db: str, event_table: str, routed: bool, schema: str = "public") -> tuple[str, str]:
    """PostgreSQL schema and table: the routed database, else the sink's schema."""
    return (event_db if routed else schema), event_table


def sql_statements(log: DataFrame, dialect: str, database: str, table: str, keys: tuple[str, ...]) -> DataFrame:
    """``seq, sub_seq, sql, args``: current-state writes; a key change is a delete and a write.

    ``args`` are texts in order of the place holders.  PostgreSQL refuses null keys.
    """
    kind = image_type(log)
    columns = tuple(kind.fieldNames())
    args = lambda side, names: F.array(*(F.col(f"{side}.`{n}`").cast("string") for n in names))
    write = F.struct(F.lit(1).alias("sub_seq"), F.lit(upsert_sql(dialect, database, table, columns, keys)).alias("sql"), args("after", columns).alias("args"))
    if keys:
        cut = F.struct(F.lit(0).alias("sub_seq"), F.lit(delete_sql(dialect, database, table, keys)).alias("sql"), args("before", keys).alias("args"))
        out = F.when(F.col("op") == "d", F.array(cut)).when((F.col("op") == "u") & key_changed(keys), F.array(cut, write)).otherwise(F.array(write))
        if dialect == "postgresql":
            null = lambda side: reduce(lambda a, b: a | b, (F.col(f"{side}.`{k}`").isNull() for k in keys))
            out = F.when(F.when(F.col("op") == "d", null("before")).otherwise(null("after")), F.raise_error(F.lit("a key is null"))).otherwise(out)
    else:
        out = F.when(F.col("op") == "d", F.raise_error(F.lit(f"{dialect}: {database}.{table} has no key for delete"))).otherwise(F.array(write))
    return log.select("seq", F.explode(out).alias("s")).select("seq", "s.*")


def write_statements(last: DataFrame, dialect: str, database: str, table: str, keys: tuple[str, ...]) -> DataFrame:
    """``sql, args`` of last writes (``row, deleted``): one statement a key, so they may run in any order."""
    columns = tuple(image_type(last, "row").fieldNames())
    args = lambda names: F.array(*(F.col(f"row.`{n}`").cast("string") for n in names))
    put = F.struct(F.lit(upsert_sql(dialect, database, table, columns, keys)).alias("sql"), args(columns).alias("args"))
    if not keys:
        return last.select(put.alias("s")).select("s.*")
    cut = F.struct(F.lit(delete_sql(dialect, database, table, keys)).alias("sql"), args(keys).alias("args"))
    return last.select(F.when(F.col("deleted"), cut).otherwise(put).alias("s")).select("s.*")


#: PostgreSQL states that are worth another try.
POSTGRES_RETRYABLE = ("40001", "40P01", "57P01", "57P03")


def retryable(dialect: str, state: str, committing: bool = False) -> bool:
    """Whether a failed batch may be sent again: never after a failed COMMIT."""
    if committing:
        return False
    return dialect == "mysql" or state in POSTGRES_RETRYABLE or state.startswith("08")
