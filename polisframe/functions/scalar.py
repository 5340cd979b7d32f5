"""Typed comparison, logic, arithmetic and text functions for filters.

Operands carry a comparison type, so that a filter on mismatched types is an error when it is built instead of a cast
failure on some executor. Everything returned is a plain Column.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from typing import Any, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from polisframe.model import ModelError

NUMERIC = ("integer", "double")
SCALAR = ("boolean", "integer", "double", "string", "timestamp", "date")


@dataclass(frozen=True)
class Operand:
    """A scalar expression and its type; ``value`` is set for literals, ``untyped`` for generic attributes."""

    column: Column
    type: str
    value: Any = None
    untyped: bool = False

    @property
    def is_literal(self) -> bool:
        return self.value is not None


def literal(value: Any) -> Operand:
    if isinstance(value, bool):
        kind = "boolean"
    elif isinstance(value, int):
        kind = "integer"
    elif isinstance(value, float):
        kind = "double"
    elif isinstance(value, dt.datetime):
        kind = "timestamp"
    elif isinstance(value, dt.date):
        kind = "date"
    elif isinstance(value, str):
        kind = "string"
    else:
        raise ModelError(f"unsupported literal {value!r}")
    return Operand(F.lit(value), kind, value)


def operand(value: Any, kind: str | None = None) -> Operand:
    if isinstance(value, Operand):
        return value
    if isinstance(value, Column):
        if kind is None:
            raise ModelError("a column operand needs its type")
        return Operand(value, kind)
    return literal(value)


# -- implicit casts

_TRUE, _FALSE = ("true", "t", "1", "yes"), ("false", "f", "0", "no")


def _cast(x: Operand, target: str) -> Operand:
    if x.type == target:
        return x
    if x.untyped and not x.is_literal:
        raise ModelError(f"cannot compare a generic attribute with a {target}; cast it explicitly")
    if x.is_literal:
        if target == "boolean" and x.type in ("integer", "double"):
            return literal(x.value != 0)
        if target == "boolean" and x.type == "string" and x.value.lower() in _TRUE + _FALSE:
            return literal(x.value.lower() in _TRUE)
        if target == "integer" and x.type in ("string", "double"):
            number = _number(x.value)
            if number is not None and number == math.floor(number):
                return literal(int(number))
        if target == "double" and x.type in ("string", "integer"):
            number = _number(x.value)
            if number is not None:
                return literal(float(number))
        if target == "string":
            text = str(x.value).lower() if isinstance(x.value, bool) else str(x.value)
            return literal(text)
    if target == "double" and x.type == "integer":
        return Operand(x.column.cast("double"), "double")
    if target == "date" and x.type == "timestamp":
        return Operand(F.to_date(x.column), "date")
    return x


def _number(value) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def unify(a: Operand, b: Operand) -> tuple[Operand, Operand]:
    """Bring both operands to one type, or fail: literals follow columns, integers widen, timestamps meet dates."""
    if a.type != b.type:
        pair = {a.type, b.type}
        if pair == {"integer", "double"}:
            if a.is_literal and a.type == "double" and a.value == math.floor(a.value) or \
                    b.is_literal and b.type == "double" and b.value == math.floor(b.value):
                a, b = (_cast(a, "integer"), b) if a.is_literal and a.type == "double" else (
                    (a, _cast(b, "integer")) if b.is_literal and b.type == "double" else (a, b))
            if a.type != b.type:
                a, b = _cast(a, "double"), _cast(b, "double")
        elif pair == {"timestamp", "date"}:
            a, b = _cast(a, "date"), _cast(b, "date")
        elif b.is_literal:
            b = _cast(b, a.type)
        elif a.is_literal:
            a = _cast(a, b.type)
    if a.type != b.type or a.type not in SCALAR:
        raise ModelError(f"cannot compare {a.type} with {b.type}")
    return a, b


# -- predicates

_OPERATORS = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compare(a, op: str, b) -> Column:
    a, b = unify(operand(a), operand(b))
    return _OPERATORS[op](a.column, b.column)


def between(x, low, high, negate: bool = False) -> Column:
    x, low, high = operand(x), operand(low), operand(high)
    for part in (x, low, high):
        if part.type not in NUMERIC:
            raise ModelError("BETWEEN takes numbers only")
    inside = compare(x, ">=", low) & compare(x, "<=", high)
    return ~inside if negate else inside


def in_list(x, values: Sequence, negate: bool = False) -> Column:
    x, values = operand(x), [operand(v) for v in values]
    if not values:
        raise ModelError("IN needs at least one value")
    pairs = [unify(x, v) for v in values]
    kinds = {b.type for _, b in pairs}
    if len(kinds) > 1 and kinds != {"integer", "double"}:
        raise ModelError("IN takes values of one type")
    if kinds == {"integer", "double"}:
        pairs = [(_cast(a, "double"), _cast(b, "double")) for a, b in pairs]
    found = pairs[0][0].column.isin(*[b.column for _, b in pairs])
    return ~found if negate else found


def like(x, pattern, negate: bool = False) -> Column:
    """``%`` and ``_`` wildcards, escaped by a backslash."""
    x, pattern = operand(x), operand(pattern)
    if (x.type, pattern.type) != ("string", "string"):
        raise ModelError("LIKE takes strings only")
    found = F.like(x.column, pattern.column)
    return ~found if negate else found


def is_null(x, negate: bool = False) -> Column:
    column = operand(x).column if isinstance(x, Operand) else x
    return column.isNotNull() if negate else column.isNull()


def all_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def negate(condition: Column) -> Column:
    return ~condition


# -- arithmetic

def integer_divide(a: Column, b: Column) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("try_divide", a - a % b, b).cast("bigint")


def truncate(q: Column) -> Column:
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("double")


def arithmetic(a, op: str, b) -> Operand:
    a, b = operand(a), operand(b)
    if a.type not in NUMERIC or b.type not in NUMERIC:
        raise ModelError("arithmetic takes numbers only")
    whole = a.type == b.type == "integer"
    kind = "integer" if whole else "double"
    x, y = (a.column, b.column) if whole else (a.column.cast("double"), b.column.cast("double"))
    if op == "+":
        return Operand(x + y, kind)
    if op == "-":
        return Operand(x - y, kind)
    if op == "*":
        return Operand(x * y, kind)
    if op == "/":
        return Operand(integer_divide(x, y) if whole else x / y, kind)
    if op == "div":
        return Operand(integer_divide(x, y) if whole else truncate(x / y), kind)
    if op == "%":
        return Operand(x % y, kind)
    if op == "^":
        return Operand(F.pow(x, y), "double")
    raise ModelError(f"unknown operator {op!r}")


def minus(x) -> Operand:
    x = operand(x)
    if x.type not in NUMERIC:
        raise ModelError("only numbers have a sign")
    return Operand(-x.column, x.type)


# -- text

# Latin letters with diacritics and their base letters, pairwise by position.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿĀāĂăĄąĆćČčĎďĐđĒēĖėĘęĚěĞğĪīĮįİıĹĺĽľŁłŃńŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyyAaAaAaCcCcDdDdEeEeEeEeGgIiIiIiLlLlLlNnNnOoOoRrRrSsSsSsTtTtUuUuUuUuYZzZzZz"


def _text(x) -> Operand:
    x = operand(x)
    if x.type != "string":
        raise ModelError("a text function takes strings only")
    return x


def casei(x) -> Operand:
    """Lower-case both sides of a comparison to ignore case."""
    x = _text(x)
    return Operand(F.lower(x.column), "string", x.value.lower() if x.is_literal else None)


def accenti(x) -> Operand:
    """Replace accented Latin letters by their base letter; ß and ligatures become two letters."""
    c = F.translate(_text(x).column, ACCENTED, PLAIN)
    for letter, pair in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        c = F.replace(c, F.lit(letter), F.lit(pair))
    return Operand(c, "string")


def upper(x) -> Operand:
    return Operand(F.upper(_text(x).column), "string")


# -- lengths

# Metres per unit, radians per unit, and the accepted unit names.
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001, "km": 1000.0, "ft": 0.3048, "in": 0.0254, "yd": 0.9144,
          "mi": 1609.344, "nmi": 1852.0}
RADIANS = {"rad": 1.0, "deg": math.pi / 180}
UNIT_NAMES = {
    "centimetre": "cm", "centimeter": "cm", "degree": "deg", "degree angle": "deg", "degrees": "deg", "foot": "ft",
    "feet": "ft", "inch": "in", "inches": "in", "kilometre": "km", "kilometer": "km", "metre": "m", "meter": "m",
    "mile": "mi", "miles": "mi", "millimetre": "mm", "millimeter": "mm", "nautical mile": "nmi",
    "nautical miles": "nmi", "radian": "rad", "radians": "rad", "yard": "yd", "yards": "yd",
}


def _unit(name: str) -> str:
    name = name.strip().lower()
    return UNIT_NAMES.get(name) or UNIT_NAMES.get(name.rstrip("s"), name)


def convert_length(value: float, unit: str | None, axis_unit: str = "m") -> float:
    """A length or angle in ``unit``, expressed in the unit of the reference system's first axis."""
    if unit is None:
        return value
    unit, axis_unit = _unit(unit), _unit(axis_unit)
    for table in (METRES, RADIANS):
        if unit in table and axis_unit in table:
            return value * table[unit] / table[axis_unit]
    raise ModelError(f"cannot convert {unit!r} to {axis_unit!r}")
