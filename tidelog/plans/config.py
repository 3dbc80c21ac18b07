"""Strict settings of a pipeline.

Each block is a table of keys with a reader; a key that isn't there is an error that names it, and
the settings that other change-capture tools have under this block are refused the same way.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.transform import compile_rule
from .selector import ConfigError, Route, Rule, Selector, compile_pattern

# --- readers -------------------------------------------------------------------------

UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def as_int(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError("not an integer")
    if isinstance(value, float) and value != int(value):
        raise ValueError("not an integer")
    return int(value)


def as_bool(value: object) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    raise ValueError("not a boolean")


def as_seconds(value: object) -> float:
    """``1m30s`` and the like; plain integers are milliseconds."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value / 1000
    if not isinstance(value, str) or not re.fullmatch(r"[+-]?(\d+(\.\d*)?(ns|us|µs|ms|s|m|h))+|0", value):
        raise ValueError("not a duration")
    total = sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h)", value))
    return -total if value.startswith("-") else total


def as_list(value: object) -> list[str]:
    items = value.split(",") if isinstance(value, str) else value
    if not isinstance(items, list):
        raise ValueError("must be a string or list")
    out = [str(x).strip() for x in items]
    if isinstance(value, str):
        out = [x for x in out if x]
    if not out or not all(out):
        raise ValueError("empty list or entry")
    return out


def text(value: object) -> str:
    return str(value).strip()


def at_least(least: float, read: Callable = as_int, most: float = float("inf")) -> Callable:
    def check(value: object):
        out = read(value)
        if not least <= out <= most:
            raise ValueError(f"must be >= {least:g}" + ("" if most == float("inf") else f" and <= {most:g}"))
        return out

    return check


def positive(value: object) -> float:
    out = as_seconds(value)
    if out <= 0:
        raise ValueError("must be a positive duration")
    return out


def one_of(*allowed: str) -> Callable:
    def check(value: object) -> str:
        if str(value) not in allowed:
            raise ValueError(f"unknown value {value}")
        return str(value)

    return check


def read_block(name: str, raw: object, keys: dict[str, tuple[str, Callable]], refused: tuple[str, ...] = ()) -> dict:
    """attribute -> value; ``keys`` maps a setting to its attribute and reader."""
    if raw is None:
        raise ConfigError(name, "required")
    if not isinstance(raw, dict):
        raise ConfigError(name, "must be a mapping")
    out = {}
    for key, value in raw.items():
        if key in refused or any(r.endswith("*") and key.startswith(r[:-1]) for r in refused):
            raise ConfigError(f"{name}.{key}", "not supported")
        if key not in keys:
            raise ConfigError(f"{name}.{key}", "unknown field")
        attribute, read = keys[key]
        try:
            out[attribute] = read(value)
        except ValueError as e:
            raise ConfigError(f"{name}.{key}", str(e)) from e
    return out


def need(name: str, values: dict, *attributes: str) -> None:
    for a in attributes:
        if not values.get(a):
            raise ConfigError(f"{name}.{a.replace('_', '-')}", "required")


# --- blocks --------------------------------------------------------------------------

#: Setting names, defaults and limits.
MODES = ("initial", "snapshot", "earliest", "latest", "specific-offset", "timestamp")
SOURCE_KEYS: dict[str, tuple[str, Callable]] = {
    "type": ("type", one_of("mysql")),
    "hostname": ("hostname", text),
    "port": ("port", as_int),
    "username": ("username", text),
    "password": ("password", text),
    "tables": ("tables", text),
    "tables.exclude": ("tables_exclude", text),
    "server-id": ("server_id", at_least(1)),
    "server-time-zone": ("time_zone", text),
    "scan.startup.mode": ("mode", one_of(*MODES)),
    "scan.startup.specific-offset.file": ("offset_file", text),
    "scan.startup.specific-offset.pos": ("offset_pos", at_least(0)),
    "scan.startup.specific-offset.gtid-set": ("offset_gtid", text),
    "scan.startup.specific-offset.skip-events": ("skip_events", at_least(0)),
    "scan.startup.specific-offset.skip-rows": ("skip_rows", at_least(0)),
    "scan.startup.timestamp-millis": ("timestamp_ms", at_least(0)),
    "scan.incremental.snapshot.chunk.size": ("chunk_size", at_least(1)),
    "scan.incremental.snapshot.chunk.key-column": ("chunk_key", text),
    "scan.snapshot.fetch.size": ("fetch_size", at_least(1)),
    "schema-change.enabled": ("schema_change", as_bool),
    "scan.newly-added-table.enabled": ("new_tables", as_bool),
    "scan.newly-added-table.snapshot.enabled": ("new_tables_snapshot", as_bool),
    "scan.binlog.newly-added-table.enabled": ("follow_runtime", as_bool),
    "connect.timeout": ("connect_timeout", at_least(0.25, as_seconds)),
    "heartbeat.interval": ("heartbeat", as_seconds),
}
SOURCE_REFUSED = ("debezium.*", "snapshot-mode", "scan.parse.online.schema.changes.enabled", "metadata.list", "treat-tinyint1-as-boolean.enabled", "use.legacy.json.format")
SOURCE_DEFAULTS = dict(
    port=3306, tables_exclude="", server_id=0, time_zone="UTC", mode="initial", offset_file="", offset_pos=0, offset_gtid="", skip_events=0, skip_rows=0, timestamp_ms=0, chunk_size=8096, chunk_key="", fetch_size=1024,
    schema_change=True, new_tables=False, new_tables_snapshot=True, follow_runtime=False, connect_timeout=30.0, heartbeat=30.0,
)

SINK_TYPES = ("stdout", "mysql", "kafka", "doris", "elasticsearch", "postgresql")
COMMON_SINK: dict[str, tuple[str, Callable]] = {
    "type": ("type", text),
    "hostname": ("hostname", text),
    "port": ("port", as_int),
    "username": ("username", text),
    "password": ("password", text),
    "write-batch-size": ("batch_size", at_least(1)),
    "write-batch-interval": ("batch_interval", as_seconds),
    "max-retries": ("max_retries", at_least(0)),
    "schema.change.drop-truncate.enabled": ("drop_truncate", as_bool),
    "database": ("database", text),
}
#: setting -> attribute, reader, sinks that take it
SINK_KEYS: dict[str, tuple[str, Callable, tuple[str, ...]]] = {
    "auto-create-table": ("auto_create", as_bool, ("mysql", "doris", "postgresql")),
    "auto-create": ("auto_create", as_bool, ("elasticsearch",)),
    "hosts": ("hosts", as_list, ("elasticsearch",)),
    "version": ("version", lambda v: int(v) if isinstance(v, str) else as_int(v), ("elasticsearch",)),
    "index-name": ("index_name", text, ("elasticsearch",)),
    "mapping-file": ("mapping_file", text, ("elasticsearch",)),
    "bulk-max-bytes": ("bulk_bytes", as_int, ("elasticsearch",)),
    "request-timeout": ("request_timeout", positive, ("doris", "elasticsearch")),
    "brokers": ("brokers", as_list, ("kafka",)),
    "topic": ("topic", text, ("kafka",)),
    "source-name": ("source_name", text, ("kafka",)),
    "client-id": ("client_id", text, ("kafka",)),
    "schema.change.emit.enabled": ("emit_ddl", as_bool, ("kafka",)),
    "allow.auto.create.topics": ("auto_topics", as_bool, ("kafka",)),
    "producer-batch-max-bytes": ("producer_bytes", at_least(512, as_int, 100 << 20), ("kafka",)),
    "flush-timeout": ("flush_timeout", positive, ("kafka",)),
    "sql-port": ("sql_port", at_least(1, as_int, 65535), ("doris",)),
    "schema.change.enabled": ("schema_change", as_bool, ("doris", "postgresql")),
    "schema.change.include": ("include", as_list, ("doris", "postgresql")),
    "schema.change.wait-timeout": ("wait_timeout", positive, ("doris",)),
    "partial-update.enabled": ("partial_update", as_bool, ("doris",)),
    "delete.enabled": ("deletes", as_bool, ("doris",)),
    "buckets": ("buckets", lambda v: text(v).lower(), ("doris",)),
    "replication-num": ("replication", at_least(0), ("doris",)),
    "schema": ("schema", text, ("postgresql",)),
    "sslmode": ("sslmode", one_of("disable", "allow", "prefer", "require", "verify-ca", "verify-full"), ("postgresql",)),
    "connect-timeout": ("connect_timeout", at_least(0.25, as_seconds), ("postgresql",)),
}
SINK_DEFAULTS = dict(port=3306, batch_size=1000, batch_interval=1.0, max_retries=3, auto_create=True, drop_truncate=False, database="")
TYPE_DEFAULTS: dict[str, dict] = {
    "kafka": dict(auto_topics=True, producer_bytes=10 << 20, emit_ddl=False, flush_timeout=30.0, source_name="mysql_binlog_source"),
    "doris": dict(port=8030, sql_port=9030, request_timeout=30.0, buckets="auto", include=["add.column"], wait_timeout=5.0, schema_change=False, replication=0),
    "elasticsearch": dict(auto_create=False, version=8, request_timeout=30.0, bulk_bytes=5 << 20, index_name=""),
    "postgresql": dict(port=5432, auto_create=False, schema="public", sslmode="prefer", connect_timeout=30.0, schema_change=False, include=[]),
}
BULK_RANGE = (1024, 100 << 20)
CHANGE_KINDS = ("add.column", "drop.column", "rename.column", "modify.column", "drop.table", "truncate")


class Block(dict):
    """Values by attribute."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e


def parse_source(raw: object) -> Block:
    properties = {}
    if isinstance(raw, dict):
        properties = {k[len("jdbc.properties.") :]: str(v) for k, v in raw.items() if k.startswith("jdbc.properties.")}
        if "" in properties:
            raise ConfigError("source.jdbc.properties.", "the property has no name")
        raw = {k: v for k, v in raw.items() if not k.startswith("jdbc.properties.")}
    own = read_block("source", raw, SOURCE_KEYS, SOURCE_REFUSED)
    need("source", own, "hostname", "username", "password")
    out = Block(SOURCE_DEFAULTS | own | {"jdbc_properties": properties})
    out["selector"] = Selector.of(out.get("tables", ""), out.tables_exclude)
    if out.mode == "specific-offset" and not out.offset_gtid and not (out.offset_file and out.offset_pos):
        raise ConfigError("source.scan.startup.specific-offset", "give file and pos, or gtid-set")
    if out.mode == "timestamp" and not out.timestamp_ms:
        raise ConfigError("source.scan.startup.timestamp-millis", "required")
    return out


def check_index_name(name: str) -> None:
    """Raises where the name is none that an index can have."""
    if name in (".", "..") or len(name.encode()) > 255 or name != name.lower() or name[0] in "_-+" or re.search(r'[\\/*?"<>| ,#:]', name):
        raise ConfigError("sink.index-name", f"{name!r} is no index name")


def _check_sink(kind: str, out: Block) -> None:
    if kind == "mysql":
        need("sink", out, "hostname", "username", "password")
    elif kind == "kafka":
        need("sink", out, "brokers", "topic")
        if re.search(r"\s", out.topic):
            raise ConfigError("sink.topic", "has white space")
    elif kind == "doris":
        need("sink", out, "hostname", "username")
        if "://" in out.hostname or re.search(r"[/?#]", out.hostname):
            raise ConfigError("sink.hostname", "give a bare host name")
        for attribute, key in (("partial_update", "partial-update.enabled"), ("deletes", "delete.enabled"), ("drop_truncate", "schema.change.drop-truncate.enabled")):
            if out.get(attribute):
                raise ConfigError(f"sink.{key}", "not supported by this sink")
        if set(out.include) - {"add.column"}:
            raise ConfigError("sink.schema.change.include", "only add.column is supported")
        if out.buckets != "auto" and not (out.buckets.isdigit() and int(out.buckets)):
            raise ConfigError("sink.buckets", "neither auto nor a positive number")
    elif kind == "postgresql":
        need("sink", out, "hostname", "username", "password", "database")
        for name in ("database", "schema"):
            if not out[name] or "." in out[name]:
                raise ConfigError(f"sink.{name}", "give one name without dots")
        if unknown := [x for x in out.include if x not in CHANGE_KINDS]:
            raise ConfigError("sink.schema.change.include", f"{unknown[0]!r} is no change that this sink makes")
    elif kind == "elasticsearch":
        need("sink", out, "hosts")
        if any(not re.match(r"https?://[^/\s]+", h) for h in out.hosts):
            raise ConfigError("sink.hosts", "give http or https URLs")
        if out.version not in (7, 8, 9):
            raise ConfigError("sink.version", "is none of 7, 8, 9")
        if bool(out.get("username")) != bool(out.get("password")):
            raise ConfigError("sink.username", "username and password go together")
        out["bulk_bytes"] = out.bulk_bytes or TYPE_DEFAULTS[kind]["bulk_bytes"]
        if not BULK_RANGE[0] <= out.bulk_bytes <= BULK_RANGE[1]:
            raise ConfigError("sink.bulk-max-bytes", f"must be 0 or in {BULK_RANGE[0]}..{BULK_RANGE[1]}")
        if out.index_name:
            check_index_name(out.index_name)
        if out.get("mapping_file"):
            try:
                out["mapping"] = json.loads(Path(out.mapping_file).read_text())
            except (OSError, ValueError) as e:
                raise ConfigError("sink.mapping-file", str(e)) from e
            if not isinstance(out["mapping"], dict):
                raise ConfigError("sink.mapping-file", "must be a JSON object")
    if kind in ("doris", "postgresql") and not 1 <= out.port <= 65535:
        raise ConfigError("sink.port", "must be in 1..65535")


def parse_sink(raw: object) -> Block:
    if not isinstance(raw, dict):
        raise ConfigError("sink", "required" if raw is None else "must be a mapping")
    kind = text(raw.get("type") or "")
    if kind not in SINK_TYPES:
        raise ConfigError("sink.type", f"unknown type {kind}" if kind else "required")
    for key in sorted(raw):
        if key in SINK_KEYS and kind not in SINK_KEYS[key][2]:
            raise ConfigError(f"sink.{key}", f"belongs to {', '.join(SINK_KEYS[key][2])}")
    own = read_block("sink", raw, COMMON_SINK | {k: (a, r) for k, (a, r, _) in SINK_KEYS.items()})
    out = Block(SINK_DEFAULTS | TYPE_DEFAULTS.get(kind, {}) | own)
    _check_sink(kind, out)
    return out


def _items(name: str, raw: object, known: tuple[str, ...], ignored: tuple[str, ...] = ()) -> list[dict[str, str]]:
    if raw is None:
        return []
    if not isinstance(raw, list):
        raise ConfigError(name, "must be a list")
    out = []
    for i, item in enumerate(raw):
        if not isinstance(item, dict):
            raise ConfigError(name, f"entry {i} is no mapping")
        if unknown := [k for k in item if k not in known and k not in ignored]:
            raise ConfigError(name, f"entry {i} has the unknown field {unknown[0]}")
        own = {k: str(v) for k, v in item.items() if k in known}
        if not own.get("source-table"):
            raise ConfigError(name, f"entry {i} lacks source-table")
        out.append(own)
    return out


def parse_routes(raw: object) -> list[Route]:
    out = []
    for i, item in enumerate(_items("route", raw, ("source-table", "sink-table", "replace-symbol", "description"))):
        sink = item.get("sink-table", "")
        if "." not in sink:
            raise ConfigError("route", f"entry {i}: sink-table needs the form database.table")
        out.append(Route(compile_pattern("route", item["source-table"]), sink, item.get("replace-symbol", "")))
        out[-1].target("x")
    return out


def parse_transforms(raw: object) -> list[Rule]:
    known = ("source-table", "projection", "filter", "primary-keys", "description")
    ignored = ("partition-keys", "table-options", "converter-after-transform")
    out = []
    for i, item in enumerate(_items("transform", raw, known, ignored)):
        try:
            out.append(compile_rule(item["source-table"], item.get("projection", ""), item.get("filter", ""), item.get("primary-keys", "")))
        except ConfigError:
            raise
        except ValueError as e:
            raise ConfigError("transform", f"entry {i}, filter: {e}") from e
    return out


RUNTIME_KEYS: dict[str, tuple[str, Callable]] = {"name": ("name", str), "parallelism": ("parallelism", at_least(1)), "route-mode": ("route_mode", one_of("ALL_MATCH", "FIRST_MATCH"))}
CHECKPOINT_KEYS: dict[str, tuple[str, Callable]] = {"storage": ("storage", one_of("file")), "interval": ("interval", positive), "file-path": ("file_path", text)}
def any_case(*allowed: str, **other: str) -> Callable:
    def check(value: object) -> str:
        out = {x.lower(): x for x in allowed} | other
        if str(value).strip().lower() not in out:
            raise ValueError(f"must be one of {', '.join(allowed)}")
        return out[str(value).strip().lower()]

    return check


SIZE_UNITS = {"b": 1, "byte": 1, "bytes": 1, "kb": 1 << 10, "kib": 1 << 10, "mb": 1 << 20, "mib": 1 << 20, "gb": 1 << 30, "gib": 1 << 30}
SPAN_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def as_span(value: str) -> float:
    """``30 days`` or ``1h30m``, in seconds."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(second|minute|hour|day|week)s?", value.strip().lower())
    out = float(m[1]) * SPAN_UNITS[m[2]] if m else as_seconds(value.strip())
    if out <= 0:
        raise ValueError("duration must be positive")
    return out


def as_rotation(value: object) -> dict:
    """When a log file is changed: a size, a time of day, or a duration."""
    raw = str(value).strip().lower()
    if m := re.fullmatch(r"(\d+):(\d+)", raw):
        if int(m[1]) > 23 or int(m[2]) > 59:
            raise ValueError("HH:MM is out of range")
        return {"daily_at": (int(m[1]), int(m[2]))}
    if (m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*([a-z]+)", raw)) and m[2] in SIZE_UNITS:
        size = int(float(m[1]) * SIZE_UNITS[m[2]])
        if size <= 0:
            raise ValueError("size must be positive")
        return {"bytes": size}
    return {"seconds": as_span(raw)}


def as_retention(value: object) -> dict:
    """Which old files stay: a count, or an age."""
    raw = str(value).strip().lower()
    if m := re.fullmatch(r"(\d+)( files?)?", raw):
        if not int(m[1]):
            raise ValueError("count must be a positive integer")
        return {"files": int(m[1])}
    return {"seconds": as_span(raw)}


def as_compression(value: object) -> bool:
    return any_case("none", "gz", gzip="gz", off="none", false="none", **{"": "none"})(value) == "gz"


CONSOLE_KEYS: dict[str, tuple[str, Callable]] = {"stream": ("stream", any_case("stdout", "stderr"))}
FILE_KEYS: dict[str, tuple[str, Callable]] = {"path": ("path", text), "rotation": ("rotation", as_rotation), "retention": ("retention", as_retention), "compression": ("gzip", as_compression)}
LOGGING_KEYS: dict[str, tuple[str, Callable]] = {"level": ("level", any_case("DEBUG", "INFO", "WARN", "ERROR", warning="WARN")), "format": ("format", any_case("text", "json")), "console": ("console", lambda v: v), "file": ("file", lambda v: v)}


def parse_logging(raw: object) -> Block:
    out = Block(dict(level="INFO", format="text", console=None, file=None) | read_block("logging", raw, LOGGING_KEYS))
    if isinstance(raw, dict) and "console" in raw:
        out["console"] = Block({"stream": "stderr"} | read_block("logging.console", raw["console"] or {}, CONSOLE_KEYS))
    if isinstance(raw, dict) and "file" in raw:
        out["file"] = Block(dict(rotation={"bytes": 100 << 20}, retention=None, gzip=False) | read_block("logging.file", raw["file"], FILE_KEYS))
        need("logging.file", out["file"], "path")
    return out


def checkpoint_path(base: str, name: str) -> str:
    """``<base>/<name>/<md5 of name>.ckpt``, the name without path separators."""
    folder = name.strip().replace("/", "_").replace("\\", "_").replace("..", "_") or "cdc"
    return f"{base.strip().rstrip('/' + chr(92)) or './checkpoints'}/{folder}/{hashlib.md5(name.encode()).hexdigest()}.ckpt"


@dataclass(frozen=True)
class Pipeline:
    source: Block
    sink: Block
    routes: list[Route] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    runtime: Block = field(default_factory=Block)
    checkpoint: Block = field(default_factory=Block)
    logging: Block = field(default_factory=Block)


def load_pipeline(root: object) -> Pipeline:
    """A pipeline from its parsed document."""
    if not isinstance(root, dict) or not root:
        raise ConfigError("yaml", "empty document")
    for key in root:
        if key not in ("source", "sink", "route", "transform", "pipeline", "checkpoint", "logging"):
            raise ConfigError(str(key), "unknown field")
    source, sink = parse_source(root.get("source")), parse_sink(root.get("sink"))
    routes, rules = parse_routes(root.get("route")), parse_transforms(root.get("transform"))
    runtime = read_block("pipeline", root.get("pipeline"), RUNTIME_KEYS)
    if not runtime:
        raise ConfigError("pipeline", "is empty")
    runtime = Block(dict(name="cdc", parallelism=1, route_mode="ALL_MATCH") | runtime)
    need("pipeline", runtime, "name")
    checkpoint = Block(dict(storage="file", interval=10.0, file_path="./checkpoints") | (read_block("checkpoint", root["checkpoint"], CHECKPOINT_KEYS) if root.get("checkpoint") is not None else {}))
    need("checkpoint", checkpoint, "file_path")
    checkpoint["file_path"] = checkpoint_path(checkpoint.file_path, runtime.name)
    logging = parse_logging(root["logging"] if "logging" in root else {})
    return Pipeline(source, sink, routes, rules, runtime, checkpoint, logging)


def parse_pipeline(document: str) -> Pipeline:
    """A pipeline from YAML."""
    import yaml

    try:
        return load_pipeline(yaml.safe_load(document))
    except yaml.YAMLError as e:
        raise ConfigError("yaml", str(e)) from e
