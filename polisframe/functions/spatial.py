"""Exact planar predicates on stored geometries, envelopes and literal shapes, as Column expressions.

Boxes decide first, in the JVM: only where they meet are coordinates handed, in Arrow batches, to the exact test
(``planar``); the other rows pass a null and get their answer from the boxes. z is ignored, and parts of one shape are
expected not to overlap each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.functions import planar
from polisframe.functions.geometry import envelope_of
from polisframe.functions.scalar import convert_length
from polisframe.model import ModelError

_DIMENSIONS = {"Point": 0, "MultiPoint": 0, "LineString": 1, "MultiLineString": 1, "Polygon": 2, "MultiPolygon": 2}


@dataclass(frozen=True)
class Operand:
    """A shape per row: dimension, primitives (null or empty: no shape) and box; ``constant`` for literals."""

    box: Column
    dimension: Column
    primitives: Column
    constant: tuple | None = None


def geometry_shape(geometry_type: Column, primitives: Column, box: Column | None = None) -> Operand:
    """A stored geometry, by its type code; give its ``box`` if the frame has one."""
    dimension = F.when(geometry_type <= 2, 0).when(geometry_type <= 4, 1).otherwise(2)
    return Operand(envelope_of(primitives) if box is None else box, dimension, primitives)


def box_shape(e) -> Operand:
    """The outline of an envelope as an area; null for an empty one."""
    e = F.col(e) if isinstance(e, str) else e
    return Operand(e, F.lit(2), F.when(e.isNotNull(), F.array(env.to_polygon(e))))


def literal_shape(kind: str, coordinates: Sequence) -> Operand:
    """A constant: ``("Point", (1, 2))``, ``("LineString", [p, q])``, ``("Polygon", [ring, hole])``, or a multi-form."""
    if kind not in _DIMENSIONS:
        raise ModelError(f"unknown geometry kind {kind!r}")
    nested = {"Point": lambda c: [[[c]]], "MultiPoint": lambda c: [[[p]] for p in c], "LineString": lambda c: [[c]],
              "MultiLineString": lambda c: [[line] for line in c], "Polygon": lambda c: [c],
              "MultiPolygon": lambda c: c}[kind](coordinates)
    points = [p for prim in nested for ring in prim for p in ring]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return Operand(env.box(min(xs), min(ys), max(xs), max(ys)), F.lit(_DIMENSIONS[kind]), F.lit(None),
                   (_DIMENSIONS[kind], nested))


def _near(a: Operand, b: Operand, margin: float = 0.0) -> Column:
    """Whether the boxes, grown by the tolerance and a margin, meet; null if a shape is missing."""
    return env.intersects_2d(env.expand(a.box, margin + planar.TOLERANCE), b.box)


def _exact(test, returns: str, a: Operand, b: Operand, near: Column) -> Column:
    """``test(shape, shape)`` for the rows that are near, null for the others."""
    given = [x for x in (a, b) if x.constant is None]
    if not given:
        raise ModelError("one operand must be a column")
    constants = [None if x.constant is None else x.constant for x in (a, b)]

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        fixed = [None if c is None else planar.Shape(*c) for c in constants]
        out = []
        for row in zip(*columns):
            values = iter(row)
            shapes = []
            for f in fixed:
                if f is not None:
                    shapes.append(f)
                    continue
                dim, primitives = next(values), next(values)
                filled = primitives is not None and len(primitives) > 0
                shapes.append(planar.Shape(int(dim), primitives) if filled else None)
            out.append(None if None in shapes else test(*shapes))
        return pd.Series(out, dtype="object")

    inputs = []
    for x in given:
        inputs += [F.when(near, x.dimension), F.when(near, x.primitives)]
    return run(*inputs)


def _relation(name: str, a: Operand, b: Operand) -> Column:
    near = _near(a, b)
    exact = _exact(lambda x, y: bool(getattr(planar.Relation(x, y), name)()), "boolean", a, b, near)
    return near & exact  # a filter takes the boxes first, so that only near rows are looked into


def intersects(a: Operand, b: Operand) -> Column:
    return _relation("intersects", a, b)


def disjoint(a: Operand, b: Operand) -> Column:
    return ~intersects(a, b)


def contains(a: Operand, b: Operand) -> Column:
    """b lies in a, and not only on its border."""
    return _relation("contains", a, b)


def within(a: Operand, b: Operand) -> Column:
    return _relation("within", a, b)


def equals(a: Operand, b: Operand) -> Column:
    """The same point set."""
    return _relation("equals", a, b)


def touches(a: Operand, b: Operand) -> Column:
    """Borders meet, interiors do not."""
    return _relation("touches", a, b)


def overlaps(a: Operand, b: Operand) -> Column:
    """Same dimension, interiors meet (lines: along a stretch), and neither contains the other."""
    return _relation("overlaps", a, b)


def crosses(a: Operand, b: Operand) -> Column:
    """A line or point set is partly inside and partly outside of the other; two lines cross at single points."""
    return _relation("crosses", a, b)


def dwithin(a: Operand, b: Operand, d: float, unit: str | None = None, axis_unit: str = "m") -> Column:
    """Distance at most ``d``; boxes farther apart than that are not looked into."""
    d = convert_length(d, unit, axis_unit)
    near = _near(a, b, d)
    return near & (_exact(planar.distance, "double", a, b, near) <= d)


def beyond(a: Operand, b: Operand, d: float, unit: str | None = None, axis_unit: str = "m") -> Column:
    return ~dwithin(a, b, d, unit, axis_unit)


#: What NOT makes of a predicate; the others are negated as they are.
OPPOSITE = {"intersects": "disjoint", "disjoint": "intersects"}
PREDICATES = {"intersects": intersects, "disjoint": disjoint, "contains": contains, "within": within, "equals": equals,
              "touches": touches, "overlaps": overlaps, "crosses": crosses}


def predicate(name: str, a: Operand, b: Operand, negate: bool = False) -> Column:
    """A predicate by name; negation turns intersects and disjoint into each other."""
    if name not in PREDICATES:
        raise ModelError(f"unknown spatial predicate {name!r}")
    if negate and name in OPPOSITE:
        return PREDICATES[OPPOSITE[name]](a, b)
    found = PREDICATES[name](a, b)
    return ~found if negate else found
