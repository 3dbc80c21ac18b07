"""The filter language: parser, and a compiler from its tree to a Column.

Logic is two-valued: a predicate over a null or missing value is false (``IS NULL``
apart), and ``NOT`` negates that, so ``NOT city = 'hz'`` keeps rows without a city.  A comparison
is numeric if both sides are numbers, else it orders bytes of text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FilterSyntaxError(ValueError):
    """The text is no filter."""


@dataclass(frozen=True)
class Literal:
    text: str | None  # None is NULL
    quoted: bool = False


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Literal


@dataclass(frozen=True)
class Within:
    column: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Like:
    column: str
    pattern: str


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR
    parts: tuple


TOKEN = re.compile(
    r"""\s*(?:
      (?P<string>'(?:[^']|'')*')
    | (?P<number>[+-]?[0-9][0-9.]*)
    | (?P<quoted>`[^`]+`)
    | (?P<word>[^\W\d][\w$]*|\$[\w$]*)
    | (?P<op><>|!=|<=|>=|=|<|>)
    | (?P<mark>[(),])
    )""",
    re.X,
)
KEYWORDS = {"AND", "OR", "NOT", "IS", "IN", "LIKE", "NULL"}


class _Parser:
    def __init__(self, text: str):
        self.tokens = list(self._read(text))
        self.at = 0

    @staticmethod
    def _read(text: str) -> Iterator[tuple[str, str]]:
        at, end = 0, len(text.rstrip())
        while at < end:
            m = TOKEN.match(text, at)
            if not m:
                rest = text[at:].strip()
                raise FilterSyntaxError("unterminated string" if rest.startswith("'") else f"unexpected {rest!r}")
            at = m.end()
            kind = m.lastgroup
            value = m[kind]
            if kind == "word" and value.upper() in KEYWORDS:
                kind, value = "key", value.upper()
            elif kind == "quoted":
                kind, value = "word", value[1:-1]
            yield kind, value

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str | None:
        k, v = self.peek()
        if k != kind or (value is not None and v != value):
            return None
        self.at += 1
        return v

    def chain(self, op: str, part: Callable) -> object:
        parts = [part()]
        while self.take("key", op):
            parts.append(part())
        return parts[0] if len(parts) == 1 else Logic(op, tuple(parts))

    def either(self) -> object:
        return self.chain("OR", self.both)

    def both(self) -> object:
        return self.chain("AND", self.negated)

    def negated(self) -> object:
        return Not(self.negated()) if self.take("key", "NOT") else self.primary()

    def primary(self) -> object:
        if self.take("mark", "("):
            inner = self.either()
            if not self.take("mark", ")"):
                raise FilterSyntaxError("missing )")
            return inner
        column = self.take("word")
        if column is None:
            raise FilterSyntaxError("expected column")
        if self.take("key", "IS"):
            negated = bool(self.take("key", "NOT"))
            if not self.take("key", "NULL"):
                raise FilterSyntaxError("expected NULL")
            return IsNull(column, negated)
        if self.take("key", "IN"):
            if not self.take("mark", "("):
                raise FilterSyntaxError("expected ( after IN")
            values = [self.literal()]
            while self.take("mark", ","):
                values.append(self.literal())
            if not self.take("mark", ")"):
                raise FilterSyntaxError("missing )")
            return Within(column, tuple(values))
        if self.take("key", "LIKE"):
            value = self.literal()
            if not value.quoted:
                raise FilterSyntaxError("LIKE pattern must be a string")
            return Like(column, value.text)
        op = self.take("op")
        if op is None:
            raise FilterSyntaxError("expected comparison")
        return Compare(column, "!=" if op == "<>" else op, self.literal())

    def literal(self) -> Literal:
        if self.take("key", "NULL"):
            return Literal(None)
        text = self.take("string")
        if text is not None:
            return Literal(text[1:-1].replace("''", "'"), True)
        number = self.take("number")
        if number is None:
            raise FilterSyntaxError("expected literal")
        return Literal(number)


def parse_filter(text: str) -> object:
    """The tree of a filter; ``FilterSyntaxError`` says what is wrong."""
    parser = _Parser(text)
    tree = parser.either()
    kind, value = parser.peek()
    if kind != "end":
        raise FilterSyntaxError(f"unexpected {value!r}")
    return tree


# --- to a Column ---------------------------------------------------------------------

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def number_of(text: str | None) -> Decimal | None:
    """The literal as a number, if it is one."""
    if text is None or not re.match(NUMBER.replace(r"\z", r"\Z"), text):
        return None
    return Decimal(text)


def like_regex(pattern: str) -> str:
    """``%`` and ``_`` stand for characters of one line; a backslash takes the next
    character as it is, and is dropped at the end."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            c = pattern[at : at + 1]
            out.append(re.escape(c))
        else:
            out.append({"%": r"[^\n]*", "_": r"[^\n]"}.get(c) or re.escape(c))
        at += 1
    return "^" + "".join(out) + r"\z"


def as_text(value: Column, kind: T.DataType) -> Column:
    """How a value prints where it is compared as text."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(kind, T.BinaryType):
        return F.decode(value, "UTF-8")
    return value.cast("string")


def _compare(value: Column, kind: T.DataType, op: str, literal: Literal) -> Column:
    number = number_of(literal.text)
    compare = OPERATORS[op]
    text = F.lit(literal.text)
    if isinstance(kind, T.BooleanType):
        value, kind = value.cast("int"), T.IntegerType()
    if isinstance(kind, (*INTEGRAL, T.DecimalType)):
        return compare(value, F.lit(number)) if number is not None else compare(value.cast("string"), text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return compare(value.cast("double"), F.lit(float(number))) if number is not None else compare(value.cast("string"), text)
    shown = as_text(value, kind)
    if number is None or not isinstance(kind, (T.StringType, T.BinaryType)):
        return compare(shown, text)
    scale = min(30, max(18, -number.as_tuple().exponent))
    numeric = F.when(shown.rlike(NUMBER), shown.try_cast(f"decimal(38,{scale})"))
    return F.when(numeric.isNotNull(), compare(numeric, F.lit(number))).otherwise(compare(shown, text))


Lookup = Callable[[str], "tuple[Column, T.DataType] | None"]


def _leaf(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def compile_filter(tree: object, lookup: Lookup) -> Column:
    """A Column that is true or false, never null.  ``lookup`` finds a column by name, or None."""
    if isinstance(tree, Logic):
        parts = [compile_filter(x, lookup) for x in tree.parts]
        return reduce(lambda a, b: a & b if tree.op == "AND" else a | b, parts)
    if isinstance(tree, Not):
        return ~compile_filter(tree.inner, lookup)
    found = lookup(tree.column)
    if isinstance(tree, IsNull):
        null = F.lit(True) if found is None else found[0].isNull()
        return ~null if tree.negated else null
    if found is None:
        return F.lit(False)
    value, kind = found
    if isinstance(tree, Like):
        return _leaf(as_text(value, kind).rlike(like_regex(tree.pattern)))
    if isinstance(tree, Within):
        # NULL in the list equals nothing.
        parts = [_leaf(_compare(value, kind, "=", x)) for x in tree.values if x.text is not None]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    return F.lit(False) if tree.value.text is None else _leaf(_compare(value, kind, tree.op, tree.value))


def struct_lookup(fields: T.StructType, image: str | None = None) -> Lookup:
    """Finds a field by its exact name, else by one that differs in case only."""

    def find(name: str) -> tuple[Column, T.DataType] | None:
        exact = [f for f in fields if f.name == name] or [f for f in fields if f.name.casefold() == name.casefold()]
        if not exact:
            return None
        quoted = f"`{exact[0].name}`"
        return F.col(f"{image}.{quoted}" if image else quoted), exact[0].dataType

    return find
