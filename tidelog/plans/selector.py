"""Table names: full match of patterns, selection, rules and routes, all resolved on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Schemas that are never captured.
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys")


class ConfigError(ValueError):
    """A setting is wrong; ``field`` names it."""

    def __init__(self, field: str, reason: str):
        super().__init__(f"{field}: {reason}")
        self.field = field


def compile_pattern(name: str, text: str) -> re.Pattern:
    """A pattern without look-around or back references, which linear-time engines lack."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=", text):
        raise ConfigError(name, f"invalid pattern {text!r}")
    try:
        return re.compile(text)
    except re.error as e:
        raise ConfigError(name, f"invalid pattern {text!r}: {e}") from e


def full_match(pattern: re.Pattern, value: str) -> bool:
    """Whether the leftmost match, taken with the first alternative that fits, is the whole value."""
    m = pattern.search(value)
    return m is not None and m.span() == (0, len(value))


def split_list(text: str | None) -> list[str]:
    """Comma-separated names without blanks and backticks."""
    return [x for x in (part.strip().strip("`") for part in (text or "").split(",")) if x]


@dataclass(frozen=True)
class Selector:
    """Tables that are captured."""

    include: tuple[re.Pattern, ...]
    exclude: tuple[re.Pattern, ...] = ()

    @classmethod
    def of(cls, include: str, exclude: str = "") -> Selector:
        lists = [tuple(compile_pattern(name, p) for p in (x.strip() for x in (text or "").split(",")) if p) for name, text in (("source.tables", include), ("source.tables.exclude", exclude))]
        if not lists[0]:
            raise ConfigError("source.tables", "required")
        return cls(*lists)

    def matches(self, database: str, table: str) -> bool:
        name = f"{database}.{table}"
        if database.lower() in SYSTEM_SCHEMAS:
            return False
        return any(full_match(p, name) for p in self.include) and not any(full_match(p, name) for p in self.exclude)


@dataclass(frozen=True)
class Route:
    source: re.Pattern
    sink: str
    replace_symbol: str = ""

    def target(self, table: str) -> tuple[str, str]:
        """Database and table of the sink; the symbol stands for the source table's name."""
        database, dot, name = self.sink.partition(".")
        if not (dot and database and name):
            raise ConfigError("route", f"sink-table {self.sink!r} must be database.table")
        return database, name.replace(self.replace_symbol, table) if self.replace_symbol else name


def resolve_routes(routes: list[Route], database: str, table: str, first_only: bool = False) -> list[tuple[str, str, bool]]:
    """(database, table, routed) of each copy of the table's rows, in order of the rules."""
    out = []
    for route in routes:
        if full_match(route.source, f"{database}.{table}"):
            out.append((*route.target(table), True))
            if first_only:
                break
    return out or [(database, table, False)]


def colliding_targets(routes: list[Route], tables: list[tuple[str, str]], first_only: bool = False) -> dict[tuple[str, str], list[tuple[str, str]]]:
    """Sink tables that more than one source table would write."""
    sources: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for t in tables:
        for database, table, _ in resolve_routes(routes, *t, first_only):
            sources.setdefault((database, table), []).append(t)
    return {k: v for k, v in sources.items() if len(set(v)) > 1}


@dataclass(frozen=True)
class Rule:
    """Projection, filter and keys of the tables that a pattern matches."""

    source: re.Pattern
    columns: tuple[str, ...] = ()
    filter: object = None
    keys: tuple[str, ...] = field(default=())


def match_rule(rules: list[Rule], database: str, table: str) -> Rule | None:
    return next((r for r in rules if full_match(r.source, f"{database}.{table}")), None)
