"""Type maps and target DDL of each kind of sink.  What has no lossless type raises; nothing
falls back to text."""

from __future__ import annotations

import hashlib
import re

from ..plans.ddl import Change, quote
from ..plans.schema import BYTES, Column, SchemaError, Table, parse_type

TEXT_TYPES = ("tinytext", "text", "mediumtext", "longtext")
DECIMALS = ("decimal", "numeric", "dec", "fixed")
#: Integer types by width, signed and unsigned.
DORIS_INTEGERS = {"tinyint": ("TINYINT", "SMALLINT"), "smallint": ("SMALLINT", "INT"), "mediumint": ("INT", "INT"), "int": ("INT", "BIGINT"), "integer": ("INT", "BIGINT"), "bigint": ("BIGINT", "LARGEINT"), "year": ("SMALLINT", "SMALLINT")}
POSTGRES_INTEGERS = {"tinyint": ("SMALLINT", "SMALLINT"), "smallint": ("INTEGER", "INTEGER"), "mediumint": ("INTEGER", "BIGINT"), "int": ("INTEGER", "BIGINT"), "integer": ("INTEGER", "BIGINT"), "bigint": ("BIGINT", "NUMERIC(20,0)"), "year": ("SMALLINT", "SMALLINT")}
ELASTIC_INTEGERS = {"bool": ("byte", "byte"), "boolean": ("byte", "byte"), "tinyint": ("byte", "short"), "smallint": ("short", "integer"), "mediumint": ("integer", "integer"), "int": ("integer", "long"), "integer": ("integer", "long"), "bigint": ("long", "unsigned_long")}
#: Lengths that the targets allow, and date formats.
BYTES_PER_CHAR, DORIS_CHAR, DORIS_VARCHAR = 3, 255, 65533
POSTGRES_CHAR = 10_485_760
KEYWORD_CHARS = 512
DATE_FORMATS = {"date": "yyyy-MM-dd", "datetime": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestamp": "yyyy-MM-dd HH:mm:ss.SSSSSS", "year": "yyyy"}


def _refuse(dialect: str, kind: str, why: str = "it has no lossless equivalent") -> SchemaError:
    return SchemaError(f"{dialect}: type {kind} is not supported: {why}")


def doris_type(kind: str) -> str:
    t = parse_type(kind)
    if t.base in DORIS_INTEGERS:
        return DORIS_INTEGERS[t.base][t.unsigned]
    if t.base in ("float", "double", "real"):
        return "FLOAT" if t.base == "float" else "DOUBLE"
    if t.base in ("decimal", "numeric"):
        if len(t.args) != 2 or not 1 <= t.args[0] <= 38 or t.args[1] > t.args[0]:
            raise _refuse("doris", kind, "precision must be 1 to 38 and scale within it")
        return f"DECIMAL({t.args[0]},{t.args[1]})"
    if t.base in ("char", "varchar"):
        if len(t.args) != 1 or t.args[0] < 1:
            raise _refuse("doris", kind, "a positive length is needed")
        n = t.args[0] * BYTES_PER_CHAR
        if t.base == "char" and n <= DORIS_CHAR:
            return f"CHAR({n})"
        return f"VARCHAR({n})" if n <= DORIS_VARCHAR else "STRING"
    if t.base in TEXT_TYPES:
        return "STRING"
    if t.base == "date":
        return "DATE"
    if t.base in ("datetime", "timestamp"):
        p = t.args[0] if t.args else 0
        if p > 6:
            raise _refuse("doris", kind, "fractional precision must be 0 to 6")
        return f"DATETIME({p})"
    if t.base == "json":
        return "JSONB"
    raise _refuse("doris", kind)


def postgres_type(kind: str) -> str:
    t = parse_type(kind)
    if t.base in POSTGRES_INTEGERS:
        return POSTGRES_INTEGERS[t.base][t.unsigned]
    if t.base in DECIMALS:
        if not t.args:
            return "NUMERIC(10,0)"
        p, s = (*t.args, 0)[:2]
        if not 1 <= p <= 65 or not 0 <= s <= 30 or s > p:
            raise _refuse("postgresql", kind, "precision or scale is out of range")
        return f"NUMERIC({p},{s})" if s else f"NUMERIC({p})"
    if t.base in ("float", "double", "real"):
        return "REAL" if t.base == "float" else "DOUBLE PRECISION"
    if t.base in ("char", "varchar"):
        if not t.args:
            return "CHAR(1)" if t.base == "char" else "TEXT"
        return f"{t.base.upper()}({t.args[0]})" if t.args[0] <= POSTGRES_CHAR else "TEXT"
    if t.base in TEXT_TYPES:
        return "TEXT"
    if t.base in BYTES:
        return "BYTEA"
    if t.base == "date":
        return "DATE"
    if t.base in ("datetime", "timestamp"):
        if t.args and t.args[0] > 6:
            raise _refuse("postgresql", kind, "fractional precision must be 0 to 6")
        return f"TIMESTAMP({t.args[0]})" if t.args else "TIMESTAMP"
    if t.base == "json":
        return "JSON"
    raise _refuse("postgresql", kind)


def elastic_field(kind: str) -> dict:
    t = parse_type(kind)
    if t.base in ELASTIC_INTEGERS:
        return {"type": ELASTIC_INTEGERS[t.base][t.unsigned and not (t.base == "tinyint" and t.args[:1] == (1,))]}
    if t.base in ("float", "double", "real"):
        return {"type": "float" if t.base == "float" else "double"}
    if t.base in DECIMALS or t.base in ("time", "enum", "set"):
        return {"type": "keyword"}
    if t.base in DATE_FORMATS:
        return {"type": "date", "format": DATE_FORMATS[t.base]}
    if t.base in ("char", "varchar"):
        return {"type": "keyword" if (t.args[0] if t.args else 0) <= KEYWORD_CHARS else "text"}
    if t.base in TEXT_TYPES:
        return {"type": "text"}
    if t.base == "json":
        return {"type": "object", "dynamic": True}
    if t.base in BYTES:
        return {"type": "binary"}
    raise _refuse("elasticsearch", kind)


def mysql_type(kind: str) -> str:
    """The source's own text."""
    return kind


TYPE_MAPS = {"mysql": mysql_type, "doris": doris_type, "postgresql": postgres_type}


# --- defaults and CREATE TABLE ---------------------------------------------------------

NUMERIC = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z")
NOW = re.compile(r"CURRENT_TIMESTAMP(?:\(\s*([0-6]?)\s*\))?\Z", re.I)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def mysql_default(c: Column) -> str | None:
    if c.default is None:
        return None
    value = c.default.strip()
    if c.default_is_expression:
        return "NULL" if not value else value if value.startswith("(") else f"({value})"
    if value.upper() == "NULL":
        return "NULL"
    return value if value and (NOW.match(value) or NUMERIC.match(value)) else sql_text(value if c.default else "")


def postgres_default(c: Column, kind: str) -> str | None:
    """None also where the source's expression has no certain meaning on the target."""
    if c.default is None:
        return None
    value = c.default.strip()
    if not value:
        return "''"
    if value.upper() == "NULL":
        return "NULL"
    if (now := NOW.match(value)) and kind.startswith("TIMESTAMP"):
        return f"CURRENT_TIMESTAMP({now[1]})" if now[1] else "CURRENT_TIMESTAMP"
    if c.default_is_expression or value.startswith("(") or value.startswith("0000-00-00"):
        return None
    numeric = kind.split("(")[0] in ("SMALLINT", "INTEGER", "BIGINT", "NUMERIC", "REAL", "DOUBLE PRECISION")
    return value if numeric and NUMERIC.match(value) else sql_text(value)


def doris_default(c: Column, kind: str) -> str | None:
    if c.default is None or c.default_is_expression:
        return None
    value, base = c.default.strip(), kind.split("(")[0]
    if base in ("TINYINT", "SMALLINT", "INT", "BIGINT", "LARGEINT", "FLOAT", "DOUBLE", "DECIMAL"):
        if not re.match(r"[+-]?\d+(\.\d+)?\Z", value):
            raise SchemaError(f"doris: default {value!r} of column {c.name} is no number")
        return value
    if base in ("DATE", "DATETIME"):
        return sql_text(value) if re.match(r"\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d{1,6})?)?\Z", value) else None
    return sql_text(value.replace("\\", "\\\\")) if base in ("CHAR", "VARCHAR", "STRING") else None


def _names(names: tuple[str, ...], mark: str = "`") -> str:
    return ", ".join(quote(n, mark) for n in names)


def create_mysql(t: Table) -> str:
    if not (t.database and t.table and t.columns):
        raise SchemaError(f"mysql: table {t.id} needs a database, a name and columns")
    parts = []
    for c in t.columns:
        default = mysql_default(c)
        words = [quote(c.name), c.type, f"CHARACTER SET {c.charset}" if c.charset else "", f"COLLATE {c.collation}" if c.collation else "", "NULL" if c.nullable else "NOT NULL"]
        words += ["AUTO_INCREMENT" if c.auto_increment else "", f"DEFAULT {default}" if default is not None else "", f"COMMENT {sql_text(c.comment)}" if c.comment else ""]
        parts.append(" ".join(w for w in words if w))
    if t.primary_keys:
        parts.append(f"PRIMARY KEY ({_names(t.primary_keys)})")
    for i in t.indexes:
        if i.name and i.columns:
            kind = {"FULLTEXT": "FULLTEXT KEY", "SPATIAL": "SPATIAL KEY"}.get(i.type.upper(), "UNIQUE KEY" if i.unique else "KEY")
            columns = ", ".join(quote(n) + (f"({p})" if p else "") for n, p in zip(i.columns, (*i.prefixes, *[0] * len(i.columns))))
            parts.append(f"{kind} {quote(i.name)} ({columns})")
    options = [f"DEFAULT CHARSET={t.charset}" if t.charset else "", f"COLLATE={t.collation}" if t.collation else "", f"COMMENT={sql_text(t.comment)}" if t.comment else ""]
    return " ".join([f"CREATE TABLE {quote(t.database)}.{quote(t.table)} ({', '.join(parts)})", *(o for o in options if o)])


def create_postgres(t: Table, schema: str = "public") -> str:
    """Primary key and plain unique indexes carry over; other indexes don't."""
    parts = []
    for c in t.columns:
        kind = postgres_type(c.type)
        default = postgres_default(c, kind)
        parts.append(" ".join([quote(c.name, '"'), kind, *([] if c.nullable else ["NOT NULL"]), *([] if default is None else [f"DEFAULT {default}"])]))
    if t.primary_keys:
        parts.append(f"PRIMARY KEY ({_names(t.primary_keys, chr(34))})")
    parts += [f"UNIQUE ({_names(i.columns, chr(34))})" for i in t.indexes if i.unique and i.columns and not any(i.prefixes) and i.type.upper() in ("", "BTREE", "HASH")]
    return f'CREATE TABLE {quote(schema, chr(34))}.{quote(t.table, chr(34))} ({", ".join(parts)})'


def alter_postgres(old: Table, new: Table, change: Change, schema: str = "public") -> list[str]:
    """Statements that bring a target from ``old`` to ``new``; each may be run again without harm."""
    head = f'ALTER TABLE {quote(schema, chr(34))}.{quote(new.table, chr(34))}'
    name = lambda c: quote(c, '"')
    out = []
    if change.action == "add-column":
        for c in new.columns:
            if old.column(c.name) is None:
                kind = postgres_type(c.type)
                default = postgres_default(c, kind)
                out.append(" ".join([f"{head} ADD COLUMN IF NOT EXISTS {name(c.name)} {kind}", *([] if c.nullable else ["NOT NULL"]), *([] if default is None else [f"DEFAULT {default}"])]))
    elif change.action == "drop-column":
        out = [f"{head} DROP COLUMN IF EXISTS {name(c.name)}" for c in old.columns if new.column(c.name) is None]
    else:
        for a, b in zip(old.columns, new.columns):
            if a.name != b.name:
                out.append(f"{head} RENAME COLUMN {name(a.name)} TO {name(b.name)}")
            if postgres_type(a.type) != postgres_type(b.type):
                out.append(f"{head} ALTER COLUMN {name(b.name)} TYPE {postgres_type(b.type)}")
    return out


DORIS_KEY_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT", "LARGEINT", "DATE", "DATETIME", "CHAR", "VARCHAR", "DECIMAL")


def doris_column(c: Column, key: bool = False) -> str:
    kind = doris_type(c.type)
    default = None if key else doris_default(c, kind)
    words = [quote(c.name), kind, "NOT NULL" if key or not c.nullable else "NULL"]
    words += [f"DEFAULT {default}"] if default is not None else []
    words += [f"COMMENT {sql_text(c.comment)}"] if c.comment else []
    return " ".join(words)


def create_doris(t: Table, buckets: str = "auto", replication: int = 0) -> str:
    """Unique-key model: key columns first, in key order."""
    if not t.primary_keys:
        raise SchemaError(f"doris: table {t.id} has no primary key")
    if buckets != "auto" and not (buckets.isdigit() and int(buckets) > 0):
        raise SchemaError("doris: buckets are neither auto nor a positive number")
    keys = []
    for k in t.primary_keys:
        c = t.column(k)
        if c is None:
            raise SchemaError(f"doris: primary key {k} is no column of {t.id}")
        if doris_type(c.type).split("(")[0] not in DORIS_KEY_TYPES:
            raise SchemaError(f"doris: primary key {k} maps to {doris_type(c.type)}, which can be no key")
        keys.append(c)
    lines = [doris_column(c, True) for c in keys] + [doris_column(c) for c in t.columns if c not in keys]
    sql = f"CREATE TABLE IF NOT EXISTS {quote(t.database)}.{quote(t.table)} (\n  " + ",\n  ".join(lines)
    sql += f"\n) UNIQUE KEY({_names(t.primary_keys)})\nDISTRIBUTED BY HASH({quote(t.primary_keys[0])}) BUCKETS {buckets}"
    return sql + (f'\nPROPERTIES ("replication_num" = "{replication}")' if replication else "")


# --- Elasticsearch index names and mappings ------------------------------------------------


def index_name(database: str, table: str, explicit: str = "") -> str:
    """Lower case, other characters ``_``, never starting with ``_ - +``; a changed name gets a
    short hash of the original, so names that differ stay different."""
    if explicit:
        return explicit
    raw = f"{database}.{table}"
    # bytes, as the limit is in bytes
    name = "".join(chr(b) if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789._-" else chr(b + 32) if 65 <= b <= 90 else "_" for b in raw.encode())
    if name[0] in "_-+":
        name = "cdc" + name
    suffix = "-" + hashlib.sha256(raw.encode()).hexdigest()[:12]
    if name != raw:
        name += suffix
    return name if len(name) <= 255 else name[: 255 - len(suffix)] + suffix


def derive_mapping(t: Table, overrides: dict[str, dict] | None = None) -> dict[str, dict]:
    """Properties of a table; those of a mapping file win field by field."""
    return {c.name: elastic_field(c.type) for c in t.columns} | (overrides or {})


RANKS = {"byte": 1, "short": 2, "integer": 3, "long": 4, "unsigned_long": 5}


def mapping_conflict(c: Column, target: dict, root_dynamic: str = "") -> str | None:
    """Why a column can't be written to a mapping field without changing values; None if it can."""
    own, t = elastic_field(c.type), parse_type(c.type)
    kind = target.get("type") or ("object" if target.get("properties") else "")
    if own["type"] in RANKS:
        if kind not in RANKS:
            return "the field holds no integers"
        if kind == "unsigned_long" and not t.unsigned:
            return "the field holds no negative numbers"
        return "the field is too narrow" if RANKS[kind] < RANKS[own["type"]] else None
    if t.base == "float":
        return None if kind in ("float", "double") else "the field holds no floating numbers"
    if t.base in ("char", "varchar", *TEXT_TYPES):
        return None if kind in ("keyword", "text") else "the field holds no text"
    if kind != own["type"]:
        return f"the field is no {own['type']}"
    if own["type"] == "date" and target.get("format") != own["format"]:
        return f"the field's format is not {own['format']!r}"
    if own["type"] == "object" and root_dynamic in ("strict", "false") and target.get("dynamic") is not True:
        return 'the field takes no new properties'
    return None


def mapping_conflicts(t: Table, properties: dict[str, dict], root_dynamic: str = "") -> dict[str, str]:
    out = {}
    for c in t.columns:
        why = mapping_conflict(c, properties[c.name], root_dynamic) if c.name in properties else "the mapping lacks it"
        if why:
            out[c.name] = why
    return out
