"""Schema changes: widening rules, the policy of each sink, and their effect on tables.

``plan_change`` answers for one statement: apply it (with the new table), nothing to do, or
refuse.  Applying an applied change again is nothing to do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.typemap import doris_type, postgres_type
from . import ddl
from .schema import Column, SchemaError, Table, spark_type

# --- widening ---------------------------------------------------------------------------

INTEGER_DIGITS = {"SMALLINT": 5, "INTEGER": 10, "BIGINT": 19}
DORIS_RANKS = {"TINYINT": 1, "SMALLINT": 2, "INT": 3, "BIGINT": 4, "LARGEINT": 5}


def _split(kind: str) -> tuple[str, list[int]]:
    return kind.split("(")[0].strip(), [int(x) for x in re.findall(r"\d+", kind)]


def postgres_widens(old: str, new: str) -> bool:
    """Whether a column can become ``new`` with every value kept as it is."""
    (a, x), (b, y) = _split(old.upper()), _split(new.upper())
    numeric = lambda args: ((args or [10, 0])[0] - (*args, 0, 0)[1], (*args, 0, 0)[1])
    if a == b and x == y or {(a, *x), (b, *y)} == {(a, *x[:1]), (a, *x[:1], 0)} and a == "NUMERIC":
        return True
    if a in INTEGER_DIGITS:
        if b in INTEGER_DIGITS:
            return INTEGER_DIGITS[b] > INTEGER_DIGITS[a]
        return b == "NUMERIC" and (not y or numeric(y)[0] >= INTEGER_DIGITS[a])
    if a == b == "NUMERIC":
        return bool(x) and (not y or all(p >= q for p, q in zip(numeric(y), numeric(x))))
    if a in ("CHAR", "VARCHAR"):
        return b == "TEXT" or (b in ("CHAR", "VARCHAR") and (a, b) != ("VARCHAR", "CHAR") and (y or [1])[0] >= (x or [1])[0])
    if (a, b) in (("REAL", "DOUBLE PRECISION"), ("DATE", "TIMESTAMP")):
        return True
    return a == b == "TIMESTAMP" and (y or [6])[0] >= (x or [6])[0]


def doris_fits(source: str, target: str) -> bool:
    """Whether values of a mapped type can be loaded into a target's."""
    (a, x), (b, y) = _split(source.upper()), _split(target.upper())
    if a in DORIS_RANKS:
        return DORIS_RANKS.get(b, 0) >= DORIS_RANKS[a]
    if a == b:
        if a in ("CHAR", "VARCHAR", "DATETIME"):
            return (y or [0])[0] >= (x or [0])[0]
        return a != "DECIMAL" or (y[1] >= x[1] and y[0] - y[1] >= x[0] - x[1])
    if a in ("CHAR", "VARCHAR", "STRING") and b == "STRING":
        return True
    return (a, b) == ("CHAR", "VARCHAR") and y[0] >= x[0] or (a, b) == ("FLOAT", "DOUBLE")


def doris_target_problems(source: Table, target: dict[str, dict], target_keys: tuple[str, ...]) -> list[str]:
    """Why an existing target can't take the table.  ``target`` maps a column to ``type, nullable,
    default`` (whether it has one or is generated)."""
    out = []
    if tuple(k.casefold() for k in source.primary_keys) != tuple(k.casefold() for k in target_keys):
        out.append(f"keys {list(target_keys)} are not {list(source.primary_keys)}")
    for c in source.columns:
        own = target.get(c.name)
        if own is None:
            out.append(f"column {c.name} is missing")
        elif not doris_fits(doris_type(c.type), own["type"]):
            out.append(f"column {c.name}: {doris_type(c.type)} does not fit {own['type']}")
        elif c.nullable and not own["nullable"] and c.name not in source.primary_keys:
            out.append(f"column {c.name} must be nullable")
    known = {c.name for c in source.columns}
    out += [f"extra column {n} needs a default" for n, own in target.items() if n not in known and not own["nullable"] and not own.get("default")]
    return out


def missing_columns(source: Table, target: dict[str, dict], enabled: bool) -> list[Column]:
    """Columns that a target lacks and that schema evolution may add; raises where it is off."""
    there = {n.casefold() for n in target}
    out = [c for c in source.columns if c.name.casefold() not in there]
    if out and not enabled:
        raise SchemaError(f"{source.id}: the target lacks column {out[0].name} and schema changes are off")
    return out


def check_keys(table: Table, keys: tuple[str, ...]) -> None:
    """Raises where an event's keys aren't the table's primary key, as sets."""
    if keys and {k.casefold() for k in keys} != {k.casefold() for k in table.primary_keys}:
        raise SchemaError(f"{table.id}: event keys {list(keys)} are not the primary key {list(table.primary_keys)}")


def postgres_target_problems(source: Table, target: dict[str, dict], target_keys: tuple[str, ...]) -> list[str]:
    """The same for PostgreSQL: types must be equal; a column that is missing is tolerated."""
    out = []
    if source.primary_keys and not set(source.primary_keys) <= set(target_keys):
        out.append(f"key {list(source.primary_keys)} is not covered")
    for c in source.columns:
        own = target.get(c.name)
        if own is None:
            continue
        if not (postgres_widens(postgres_type(c.type), own["type"]) and postgres_widens(own["type"], postgres_type(c.type))):
            out.append(f"column {c.name}: {postgres_type(c.type)} is not {own['type']}")
        if c.nullable and not own["nullable"]:
            out.append(f"column {c.name} must be nullable")
    known = {c.name for c in source.columns}
    return out + [f"extra column {n} needs a default" for n, own in target.items() if n not in known and not own["nullable"] and not own.get("default")]


class SchemaChangeError(RuntimeError):
    """A schema change that the policy or the target doesn't let pass; the batch fails and is replayed."""


# --- policy -----------------------------------------------------------------------------

#: Names of changes in settings.
KINDS = {ddl.ADD_COLUMN: "add.column", ddl.DROP_COLUMN: "drop.column", ddl.RENAME_COLUMN: "rename.column", ddl.MODIFY_COLUMN: "modify.column", ddl.DROP_TABLE: "drop.table", ddl.TRUNCATE: "truncate"}
COLUMN_CHANGES = (ddl.ADD_COLUMN, ddl.DROP_COLUMN, ddl.RENAME_COLUMN, ddl.MODIFY_COLUMN)


@dataclass(frozen=True)
class Policy:
    sink: str  # stdout, mysql, kafka, doris, elasticsearch, postgresql
    enabled: bool = False
    include: tuple[str, ...] = ()
    drop_truncate: bool = False
    emit: bool = False


@dataclass(frozen=True)
class Outcome:
    """``execute``, ``emit``, ``skip`` or ``fail``."""

    verb: str
    reason: str = ""


def sink_outcome(change: ddl.Change, policy: Policy, projection: tuple[str, ...] = (), captured: bool = True) -> Outcome:
    """What a sink does with a statement."""
    a = change.action
    if a == ddl.OTHER and captured and change.table:
        return Outcome("fail", "a captured table has a change that is not understood")
    if policy.sink == "stdout":
        return Outcome("emit")
    if policy.sink == "kafka":
        return Outcome("emit") if policy.emit else Outcome("skip", "emission is off")
    if a == ddl.CREATE:
        return Outcome("skip", "targets are made from projected columns")
    visible = ddl.decide(change.sql, projection, policy.drop_truncate).execute
    if policy.sink == "mysql":
        return Outcome("execute") if visible else Outcome("skip", "not visible or not allowed")
    if policy.sink == "elasticsearch":
        return Outcome("fail", "an index is never changed") if visible else Outcome("skip")
    allowed = policy.enabled and KINDS.get(a) in policy.include
    if policy.sink == "doris":
        if a == ddl.ADD_COLUMN:
            if not visible:
                return Outcome("skip", "not projected")
            if not allowed:
                return Outcome("fail", "add.column is off")
            return Outcome("execute") if len(change.add_columns) == 1 else Outcome("fail", "one column at a time")
        if a == ddl.INDEX:
            return Outcome("fail", "the key can't change") if re.search(r"\bPRIMARY\b", change.sql, re.I) else Outcome("skip")
        return Outcome("skip") if a in (ddl.DROP_TABLE, ddl.TRUNCATE) else Outcome("fail", f"{a} is not supported")
    if a in COLUMN_CHANGES:
        if not visible:
            return Outcome("skip", "not projected")
        return Outcome("execute") if allowed else Outcome("fail", f"{KINDS[a]} is off")
    if a in (ddl.DROP_TABLE, ddl.TRUNCATE):
        return Outcome("execute") if allowed and policy.drop_truncate else Outcome("skip", "needs include and the switch")
    if a == ddl.INDEX:
        plain = all(k == ddl.INDEX for k, _, _ in change.clauses) and not re.search(r"\b(PRIMARY|UNIQUE)\b", change.sql, re.I)
        return Outcome("skip") if plain else Outcome("fail", "the index carries a key")
    return Outcome("fail", f"{a} is not supported")


# --- effect on a table ---------------------------------------------------------------------


@dataclass(frozen=True)
class Applied:
    table: Table


@dataclass(frozen=True)
class NoOp:
    reason: str


@dataclass(frozen=True)
class Refused:
    reason: str


def plan_change(table: Table, change: ddl.Change, definitions: dict[str, Column] | None = None, keyed: tuple[str, ...] = ()) -> Applied | NoOp | Refused:
    """A column change on a table.  ``definitions`` are the catalog's columns after the change; a
    definition is never read from the statement.  ``keyed`` are further columns that keys use."""
    definitions = definitions or {}
    names = {c.name.casefold(): c for c in table.columns}
    keys = {k.casefold() for k in (*table.primary_keys, *keyed, *(c for i in table.indexes if i.unique for c in i.columns))}
    if change.action == ddl.ADD_COLUMN:
        new = []
        for name in change.add_columns:
            own = definitions.get(name)
            if own is None:
                return Refused(f"no definition of column {name}")
            there = names.get(name.casefold())
            if there is not None:
                if there.type != own.type and not postgres_widens(postgres_type(own.type), postgres_type(there.type)):
                    return Refused(f"column {name} exists as {there.type}")
                continue
            if not own.nullable and own.default is None:
                return Refused(f"column {name} is not null without a default")
            new.append(own)
        return Applied(replace(table, columns=(*table.columns, *new))) if new else NoOp("columns exist")
    if change.action == ddl.DROP_COLUMN:
        gone = [c for k, c, _ in change.clauses if k == ddl.DROP_COLUMN]
        used = [c for c in gone if c.casefold() in keys]
        if used:
            return Refused(f"a key uses column {used[0]}")
        there = [c for c in gone if c.casefold() in names]
        dropped = {c.casefold() for c in there}
        return Applied(replace(table, columns=tuple(c for c in table.columns if c.name.casefold() not in dropped))) if there else NoOp("columns are gone")
    if change.action in (ddl.RENAME_COLUMN, ddl.MODIFY_COLUMN):
        out, moved = table, False
        for _, old, new in change.clauses:
            new = new or old
            before, after = names.get(old.casefold()), names.get(new.casefold())
            own = definitions.get(new)
            same = old.casefold() == new.casefold()
            if before is None and after is None:
                return Refused(f"neither {old} nor {new} exists")
            if not same and before is not None and after is not None:
                return Refused(f"both {old} and {new} exist")
            current = before or after
            target = replace(own or current, name=new)
            if own is not None and current.type != own.type and not postgres_widens(postgres_type(current.type), postgres_type(own.type)):
                return Refused(f"{current.type} to {own.type} may change values")
            if target != current:
                moved = True
                out = replace(out, columns=tuple(target if c.name == current.name else c for c in out.columns), primary_keys=tuple(new if k.casefold() == old.casefold() else k for k in out.primary_keys))
        return Applied(out) if moved else NoOp("already so")
    return Refused(f"{change.action} is no column change")


def evolve_state(state: DataFrame, change: ddl.Change, table: Table) -> DataFrame:
    """A stored table brought to the columns of ``table`` after a change that was applied.

    New columns get their literal default or null; renamed ones keep their values.
    """
    renamed = {new.casefold(): old for _, old, new in change.clauses if new} if change.action == ddl.RENAME_COLUMN else {}
    names = {c.casefold(): c for c in state.columns}
    columns = []
    for c in table.columns:
        source = names.get(c.name.casefold()) or names.get(renamed.get(c.name.casefold(), "").casefold())
        kind = spark_type(c.type)
        if source is None:
            if c.default_is_expression:
                raise SchemaError(f"column {c.name} has a computed default")
            columns.append(F.lit(c.default).cast(kind).alias(c.name))
        else:
            columns.append(F.col(f"`{source}`").cast(kind).alias(c.name))
    return state.select(*columns)
