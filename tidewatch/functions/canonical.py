"""Canonical JSON of typed columns: keys in order of code points, no whitespace, texts escaped and doubles written as Python's json module writes them. Built-in functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
ESCAPES = {chr(c): f"\\{SHORT[c]}" if c in SHORT else f"\\u{c:04x}" for c in range(32)} | {'"': '\\"', "\\": "\\\\"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def unit(n: Column) -> Column:
    """A UTF-16 unit as an escape."""
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))


def text(c: Column, ascii_only: bool = False) -> Column:
    """A JSON string; texts without anything to escape are not taken apart."""
    table = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def one(x: Column) -> Column:
        known = F.try_element_at(table, x)
        if not ascii_only:
            return F.coalesce(known, x)
        at = F.ascii(x)
        pair = F.concat(unit(F.floor((at - 0x10000) / 0x400) + 0xD800), unit((at - 0x10000) % 0x400 + 0xDC00))
        return F.when(known.isNotNull(), known).when(at < 0x7F, x).when(at < 0x10000, unit(at)).otherwise(pair)

    plain = r'^[^"\\\x00-\x1f' + (r"\x7f-\x{10ffff}" if ascii_only else "") + "]*$"
    inner = F.when(c.rlike(plain), c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def shorter(digits: Column, exp: Column, x: Column) -> Column:
    """Of the two numbers with a digit less, the nearer one that is still x, else the other, else the digits as they are."""
    size = F.length(digits)
    down = F.substring(digits, F.lit(1), size - 1)
    up = (down.cast("decimal(20,0)") + 1).cast("string")
    same = lambda d: F.coalesce(F.concat(d, F.lit("E"), (exp - size + 2).cast("string")).try_cast("double") == x, F.lit(False)) & (F.length(d) == size - 1)
    # a last digit of 5 says half, and x is a little more or less; whole numbers up to 2^63 tell which
    half = F.concat(digits, F.repeat(F.lit("0"), exp - size + 1)).try_cast("decimal(38,0)")
    beyond = F.when((x >= 2.0**53) & (x < 2.0**63), F.signum(x.try_cast("long").cast("decimal(38,0)") - half)).otherwise(1)
    odd = F.substring(digits, -2, 1).isin(*"13579")
    high = (F.substring(digits, -1, 1) > "5") | ((F.substring(digits, -1, 1) == "5") & ((beyond > 0) | ((beyond == 0) & odd)))
    found = F.when(high & same(up), up).when(same(down), down).when(same(up), up).otherwise(digits)
    return F.when(size < 2, digits).otherwise(F.regexp_replace(found, "0+$", ""))


def number(c: Column) -> Column:
    """A double by its shortest digits: positional from 1e-4 up to 1e16, else with an exponent of two digits or more.

    A JVM before 19 writes some doubles with a digit or two too many; those are taken off.
    """
    said = F.abs(c).cast("string")
    mantissa = F.substring_index(said, "E", 1)
    joined = F.replace(mantissa, F.lit("."), F.lit(""))
    lead = F.length(joined) - F.length(F.regexp_replace(joined, "^0+", ""))
    exp = F.length(F.substring_index(mantissa, ".", 1)) - 1 - lead + F.when(said.contains("E"), F.substring_index(said, "E", -1).try_cast("int")).otherwise(0)
    long = F.regexp_replace(joined, "^0+|0+$", "")
    digits = F.reduce(F.array(F.lit(1), F.lit(2)), long, lambda d, _: shorter(d, exp, F.abs(c)))
    tail = F.substring(digits, F.lit(2), F.lit(17))
    power = F.concat(F.when(exp < 0, "e-").otherwise("e+"), F.when(F.abs(exp) < 10, "0").otherwise(""), F.abs(exp).cast("string"))
    after = F.substring(digits, exp + 2, F.lit(17))
    shown = (
        F.when((exp < -4) | (exp >= 16), F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), power))
        .when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
        .otherwise(F.concat(F.substring(F.rpad(digits, 17, "0"), F.lit(1), exp + 1), F.lit("."), F.when(after == "", "0").otherwise(after)))
    )
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), c.cast("string")).otherwise(F.concat(F.when(c < 0, "-").otherwise(""), shown))


def canonical(c: Column, kind: T.DataType, ascii_only: bool = False) -> Column:
    """JSON text of a column of this type; null is null, also as a field, an element or a map's value.

    Structs, maps of string keys, arrays, texts, whole numbers, doubles and booleans have a form; other types raise.
    A map of which two keys are equal cannot be; a struct of which two names are raises.
    """
    deep = lambda x, t: canonical(x, t, ascii_only)
    if isinstance(kind, T.NullType):
        return F.lit("null")
    if isinstance(kind, T.StringType):
        said = text(c, ascii_only)
    elif isinstance(kind, T.DoubleType):
        said = number(c)
    elif isinstance(kind, (T.BooleanType, *WHOLE)):
        said = c.cast("string")
    elif isinstance(kind, T.ArrayType):
        said = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: deep(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda k: F.concat(text(k, ascii_only), F.lit(":"), deep(F.element_at(c, k), kind.valueType))
        said = F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.map_keys(c)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        if len(set(kind.names)) < len(kind.names):
            raise ValueError(f"names of {kind.simpleString()} are not distinct")
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=ascii_only) + ":"), deep(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        said = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical form")
    return F.coalesce(said, F.lit("null")) if isinstance(kind, (T.StringType, T.DoubleType, T.BooleanType, T.ArrayType, *WHOLE)) else F.when(c.isNull(), "null").otherwise(said)


def digest(c: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(c, kind), 256)
