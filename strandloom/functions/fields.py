"""Fixed-width fields and numbers that survive malformed input under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(line: Column, start: int, end: int) -> Column:
    """Characters [start, end) counted from 0; the empty string past the end of the line."""
    return F.substring(line, start + 1, end - start)


def number(text: Column) -> Column:
    """Finite number of the trimmed text, else null: decimal, or an unsigned integer after 0x, 0o or 0b."""
    out = _parsed(text)
    return F.when(F.abs(out) < float("inf"), out)


def numbers(*texts: Column) -> Column:
    """``number`` of each text as an array. The parser is one lambda for all texts: written out for each of a record's fields it
    makes a method so long that the JVM interprets it."""
    each = F.transform(F.array(*texts), _parsed)
    return F.transform(each, lambda v: F.when(F.abs(v) < float("inf"), v))


def _parsed(text: Column) -> Column:
    t = F.trim(text)
    base = F.when(F.lower(F.substring(t, 2, 1)) == "x", 16).when(F.lower(F.substring(t, 2, 1)) == "o", 8).otherwise(2)
    out = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    based = F.call_function("conv", F.substring(t, 3, 64), base, F.lit(10)).try_cast("double")
    return out.when(t.rlike(r"^0([xX][0-9a-fA-F]{1,15}|[oO][0-7]{1,20}|[bB][01]{1,62})$"), based)


def prefix_integer(text: Column) -> Column:
    """Integer that the trimmed text begins with (12A gives 12), null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^[+-]?[0-9]+", 0), F.lit("")).try_cast("int")


def js_round(c: Column) -> Column:
    """Half rounds up, also below zero."""
    return F.floor(c + 0.5)


def float32(c: Column) -> Column:
    """Rounded to single precision, kept as double."""
    return c.cast("float").cast("double")


def uint32(c: Column) -> Column:
    return F.pmod(c.cast("long"), F.lit(4294967296))
