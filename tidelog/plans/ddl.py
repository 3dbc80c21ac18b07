"""DDL statements: tokens, classification, decisions and renaming.

A statement becomes a list of tokens first, so quotes, comments and nested parentheses need
no care afterwards; an ALTER's clauses are the runs of tokens between commas outside parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

CREATE, ADD_COLUMN, DROP_COLUMN, RENAME_COLUMN, MODIFY_COLUMN = "create", "add-column", "drop-column", "rename-column", "modify-column"
DROP_TABLE, TRUNCATE, INDEX, RENAME_TABLE, OTHER = "drop-table", "truncate", "index", "rename-table", "other"

TOKEN = re.compile(
    r"""(?P<skip>\s+|/\*.*?(?:\*/|\Z)|--[^\n]*)
      | (?P<name>`(?:[^`]|``)*`)
      | (?P<text>'(?:[^'\\]|\\.|'')*' | "(?:[^"\\]|\\.|"")*")
      | (?P<word>[^\s`'"(),.;=/-]+)
      | (?P<mark>.)""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        """The word in upper case; quoted names and texts are no words."""
        return self.text.upper() if self.kind == "word" else ""

    @property
    def name(self) -> str:
        return self.text[1:-1].replace("``", "`") if self.kind == "name" else self.text if self.kind == "word" else ""


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(sql) if m.lastgroup != "skip" and m[0] != ";"]


@dataclass(frozen=True)
class Change:
    """What one statement does."""

    action: str
    database: str = ""
    table: str = ""
    column: str = ""
    new_name: str = ""
    sql: str = ""
    add_columns: tuple[str, ...] = ()
    clauses: tuple[tuple[str, str, str], ...] = ()  # (kind, column, new name) of an ALTER


def _table(stream: list[Token]) -> tuple[str, str, int]:
    """Database, table and the tokens they take, behind IF [NOT] EXISTS."""
    at = 0
    if stream and stream[0].upper == "IF":
        at = 3 if len(stream) > 1 and stream[1].upper == "NOT" else 2
    if at >= len(stream) or not stream[at].name:
        return "", "", at
    first = stream[at].name
    if at + 2 < len(stream) and stream[at + 1].text == "." and stream[at + 2].name:
        return first, stream[at + 2].name, at + 3
    return "", first, at + 1


def clauses(stream: Iterable[Token]) -> list[list[Token]]:
    """Runs between commas outside parentheses."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in stream:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and t.kind == "mark" and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [c for c in out if c]


#: Words behind ADD that make an index, and those that make what is not supported.
INDEX_WORDS = ("INDEX", "KEY", "PRIMARY", "UNIQUE", "FULLTEXT", "SPATIAL")
REFUSED_WORDS = ("CONSTRAINT", "FOREIGN", "CHECK", "PARTITION")
OPTIONS = ("ALGORITHM", "LOCK")


def _name_at(clause: list[Token], at: int) -> str:
    return clause[at].name if at < len(clause) else ""


def _clause(clause: list[Token]) -> tuple[str, str, str]:
    """(kind, column, new name); kind is "" for what is not supported."""
    verb, noun = clause[0].upper, clause[1].upper if len(clause) > 1 else ""
    skip = 2 if noun == "COLUMN" else 1
    if verb == "ADD":
        if noun in INDEX_WORDS:
            return INDEX, "", ""
        return ("", "", "") if noun in REFUSED_WORDS else (ADD_COLUMN, _name_at(clause, skip), "")
    if verb == "DROP":
        if noun == "COLUMN":
            return DROP_COLUMN, _name_at(clause, 2), ""
        return (INDEX, "", "") if noun in ("INDEX", "KEY", "PRIMARY") else ("", "", "")
    if verb == "RENAME":
        if noun == "COLUMN":
            return RENAME_COLUMN, _name_at(clause, 2), _name_at(clause, 4)
        return (RENAME_TABLE, "", "") if noun in ("TO", "AS") else ("", "", "")
    if verb == "CHANGE":
        return RENAME_COLUMN, _name_at(clause, skip), _name_at(clause, skip + 1)
    if verb == "MODIFY":
        return MODIFY_COLUMN, _name_at(clause, skip), ""
    return "", "", ""


def classify(sql: str) -> Change:
    """The statement's action and names.  An ALTER of several kinds, or with a clause that is
    not supported, is ``other`` and keeps its table."""
    stream = tokens(sql)
    words = [t.upper for t in stream[:3]] + ["", "", ""]
    text = sql.strip()
    heads = (((("CREATE", "TABLE"),), CREATE), ((("DROP", "TABLE"),), DROP_TABLE), ((("TRUNCATE", "TABLE"), ("TRUNCATE",)), TRUNCATE), ((("RENAME", "TABLE"),), RENAME_TABLE))
    for forms, action in heads:
        for form in forms:
            if tuple(words[: len(form)]) == form:
                database, table, _ = _table(stream[len(form) :])
                return Change(action, database, table, sql=text)
    if words[:2] in (["CREATE", "INDEX"], ["DROP", "INDEX"]) or words[:3] == ["CREATE", "UNIQUE", "INDEX"]:
        return Change(INDEX, sql=text)
    if words[:2] != ["ALTER", "TABLE"]:
        return Change(OTHER, sql=text)
    database, table, used = _table(stream[2:])
    found = tuple(_clause(c) for c in clauses(stream[2 + used :]) if c[0].upper not in OPTIONS)
    kinds = {k for k, _, _ in found}
    added = tuple(c for k, c, _ in found if k == ADD_COLUMN)
    if len(kinds) != 1 or "" in kinds:
        return Change(OTHER, database, table, sql=text, add_columns=added, clauses=found)
    kind, column, new_name = found[0]
    return Change(kind, database, table, column, new_name, text, added, found)


def add_columns(sql: str) -> list[str]:
    """Every column that an ALTER adds, index clauses passed over."""
    return list(classify(sql).add_columns)


@dataclass(frozen=True)
class Decision:
    change: Change
    execute: bool


def decide(sql: str, projection: Iterable[str] = (), drop_truncate: bool = False) -> Decision:
    """Whether the statement itself is carried out on a target.

    CREATE never is (the target is built from projected columns); column changes are if the first
    column is visible in the projection; DROP and TRUNCATE by the switch; nothing else.
    """
    change = classify(sql)
    shown = {c.casefold() for c in projection}
    if change.action in (ADD_COLUMN, DROP_COLUMN, RENAME_COLUMN, MODIFY_COLUMN):
        return Decision(change, not shown or not change.column or change.column.casefold() in shown)
    return Decision(change, change.action in (DROP_TABLE, TRUNCATE) and drop_truncate)


def quote(name: str, mark: str = "`") -> str:
    return mark + name.replace(mark, mark * 2) + mark


def rewrite_table(sql: str, database: str, table: str) -> str:
    """The statement with its table reference replaced by the routed one."""
    stream = tokens(sql)
    change = classify(sql)
    if not change.table:
        return sql
    head = 1 if stream[0].upper == "TRUNCATE" and stream[1].upper != "TABLE" else 2
    _, _, used = _table(stream[head:])
    last = stream[head + used - 1]
    first = stream[head + used - (3 if change.database else 1)]
    return sql[: first.start] + f"{quote(database)}.{quote(table)}" + sql[last.end :]
