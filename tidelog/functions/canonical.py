"""Canonical text of values: one spelling per value, whichever path it came by.

All are Columns over Columns, so they stay in generated code.  Text that is no value of its
type raises in the query (``strict``, the default) or becomes null.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_raise(value: Column, ok: Column, out: Column, what: str, strict: bool) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"no {what}: "), value.cast("string"))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.when(ok, out).otherwise(bad))


def decimal(value: Column, scale: int, strict: bool = True) -> Column:
    """Exactly ``scale`` digits behind the point, no leading zeros, no negative zero.

    Digits beyond the scale must be zeros.  Works on text, so any width is exact.
    """
    text = F.trim(value.cast("string"))
    whole = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), "^0+(?=.)", "")
    whole = F.when(whole == "", "0").otherwise(whole)
    fraction = F.regexp_extract(text, r"\.([0-9]*)$", 1)
    kept = F.rpad(F.substring(fraction, 1, scale), scale, "0") if scale else F.lit("")
    ok = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z") & F.substring(fraction, scale + 1, 10_000).rlike(r"^0*\z")
    zero = F.concat(whole, kept).rlike(r"^0+\z")
    body = F.concat(whole, F.lit("."), kept) if scale else whole
    return _or_raise(value, ok, F.concat(F.when(text.startswith("-") & ~zero, "-").otherwise(""), body), "decimal", strict)


def date(value: Column, strict: bool = True) -> Column:
    text = F.trim(value.cast("string"))
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return _or_raise(value, text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & parsed.isNotNull(), F.substring(text, 1, 10), "date", strict)


def datetime(value: Column, strict: bool = True) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with six digits of a second, from text or a timestamp."""
    text = F.trim(value.cast("string"))
    shape = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,6}))?\z"
    seconds = F.concat(F.regexp_extract(text, shape, 1), F.lit(" "), F.regexp_extract(text, shape, 2))
    ok = text.rlike(shape) & F.try_to_timestamp(seconds, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return _or_raise(value, ok, F.concat(seconds, F.lit("."), F.rpad(F.regexp_extract(text, shape, 3), 6, "0")), "datetime", strict)


def timestamp_utc(value: Column, zone: str, strict: bool = True) -> Column:
    """The wall clock of ``zone`` as that of UTC, in datetime form."""
    text = datetime(value, strict)
    if zone.upper() == "UTC":
        return text
    return F.date_format(F.convert_timezone(F.lit(zone), F.lit("UTC"), text.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def time(value: Column, strict: bool = True) -> Column:
    """Signed hours up to 838, six digits of a second, no negative zero."""
    text = F.trim(value.cast("string"))
    shape = r"^(-?)([0-9]{1,3}):([0-9]{1,2}):([0-9]{1,2})(?:\.([0-9]*))?\z"
    part = lambda i: F.regexp_extract(text, shape, i)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    fraction = F.rpad(F.substring(part(5), 1, 6), 6, "0")
    ok = text.rlike(shape) & (number(2) <= 838) & (number(3) <= 59) & (number(4) <= 59)
    zero = (number(2) == 0) & (number(3) == 0) & (number(4) == 0) & (fraction == "000000")
    body = F.concat(number(2).cast("string"), F.lit(":"), F.lpad(number(3).cast("string"), 2, "0"), F.lit(":"), F.lpad(number(4).cast("string"), 2, "0"), F.lit("."), fraction)
    return _or_raise(value, ok, F.concat(F.when(zero, "").otherwise(part(1)), body), "time", strict)


def year(value: Column, strict: bool = True) -> Column:
    """Four digits, from a number or from four-digit text."""
    number = value.try_cast("int")
    return _or_raise(value, number.between(0, 9999), F.lpad(number.cast("string"), 4, "0"), "year", strict)


def enum(value: Column, labels: tuple[str, ...], from_index: bool, strict: bool = True) -> Column:
    """The label: index 0 and the empty text are blank, other indexes count from 1."""
    names = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    if from_index:
        ok = value.between(0, len(labels))
        out = F.when(value == 0, "").otherwise(F.get(names, (value - 1).cast("int")))
    else:
        ok = (value == "") | value.isin(*labels)
        out = value
    return _or_raise(value, ok, out, "label", strict)


def set_(value: Column, labels: tuple[str, ...], from_mask: bool, strict: bool = True) -> Column:
    """Comma-joined labels; a mask gives them in order of definition.

    The mask is a signed long of up to 64 members, the last of them the sign bit.
    """
    if not from_mask:
        members = F.split(value, ",")
        ok = (value == "") | F.forall(members, lambda m: m.isin(*labels))
        return _or_raise(value, ok, value, "member", strict)
    mask = value.cast("long")
    parts = [F.when(F.shiftrightunsigned(mask, i).bitwiseAND(F.lit(1)) == 1, F.lit(label)) for i, label in enumerate(labels)]
    ok = F.lit(True) if len(labels) >= 64 else F.shiftrightunsigned(mask, len(labels)) == 0
    return _or_raise(value, ok, F.concat_ws(",", *parts) if parts else F.lit(""), "mask", strict)


def integer(value: Column, strict: bool = True) -> Column:
    number = F.trim(value.cast("string")).try_cast("bigint")
    return _or_raise(value, F.trim(value.cast("string")).rlike(r"^[+-]?[0-9]+\z") & number.isNotNull(), number.cast("string"), "integer", strict)


def unsigned(value: Column, strict: bool = True) -> Column:
    """0 to 2^64 - 1."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("decimal(20,0)")
    return _or_raise(value, text.rlike(r"^[0-9]+\z") & (number <= F.lit(Decimal(2**64 - 1))), number.cast("string"), "unsigned integer", strict)


def floating(value: Column, kind: str = "double", strict: bool = True) -> Column:
    """Text of a finite float or double; not-a-number and infinities raise."""
    number = value.try_cast(kind)
    return _or_raise(value, number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")), number.cast("string"), "finite number", strict)


def binary(value: Column) -> Column:
    """Base64 in one line; empty bytes are empty text, null stays null."""
    return F.regexp_replace(F.base64(value), "[\r\n]", "")


def json(value: Column, strict: bool = True) -> Column:
    """Valid JSON without insignificant blanks."""
    parsed = F.try_parse_json(value)
    return _or_raise(value, parsed.isNotNull(), F.to_json(parsed), "JSON", strict)


def frame(value: Column) -> Column:
    """A text's bytes behind their count in four bytes, so that joined frames can't be confused."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 8, "0")), F.encode(value, "UTF-8"))


def document_id(scope: str, parts: list[tuple[str, Column]]) -> Column:
    """SHA-256 of the framed scope and of each key's framed name and canonical value."""
    frames = [frame(F.lit(scope))] + [frame(x) for name, value in parts for x in (F.lit(name), value)]
    return F.sha2(reduce(lambda a, b: F.concat(a, b), frames), 256)
