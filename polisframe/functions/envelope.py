"""Axis-aligned boxes as structs ``(xmin, ymin, zmin, xmax, ymax, zmax)``; a 2D box has null z, an empty one is null."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from polisframe.model import ENVELOPE, ModelError

FIELDS = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")


def box(*numbers: float) -> Column:
    """A literal box from 4 (2D) or 6 (3D) numbers, lower corner first."""
    if len(numbers) == 4:
        values = (numbers[0], numbers[1], None, numbers[2], numbers[3], None)
    elif len(numbers) == 6:
        values = tuple(numbers)
    else:
        raise ModelError("a box has 4 or 6 numbers")
    return F.struct(*[F.lit(None if v is None else float(v)).cast("double").alias(n)
                      for n, v in zip(FIELDS, values)])


def _f(e: Column | str, name: str) -> Column:
    return (F.col(e) if isinstance(e, str) else e).getField(name)


def is_3d(e) -> Column:
    return _f(e, "zmin").isNotNull() & _f(e, "zmax").isNotNull()


def intersects_2d(a, b) -> Column:
    """Closed overlap in the plane: shared edges and corners count."""
    return ((_f(a, "xmin") <= _f(b, "xmax")) & (_f(a, "xmax") >= _f(b, "xmin"))
            & (_f(a, "ymin") <= _f(b, "ymax")) & (_f(a, "ymax") >= _f(b, "ymin")))


def disjoint_2d(a, b) -> Column:
    return ~intersects_2d(a, b)


def intersects(a, b) -> Column:
    """Closed overlap; z is compared only if both boxes are 3D."""
    z = (_f(a, "zmin") <= _f(b, "zmax")) & (_f(a, "zmax") >= _f(b, "zmin"))
    return intersects_2d(a, b) & F.when(is_3d(a) & is_3d(b), z).otherwise(F.lit(True))


def contains(a, b) -> Column:
    """``b`` inside ``a``, borders included; z is compared only if both boxes are 3D."""
    z = (_f(b, "zmin") >= _f(a, "zmin")) & (_f(b, "zmax") <= _f(a, "zmax"))
    flat = ((_f(b, "xmin") >= _f(a, "xmin")) & (_f(b, "xmax") <= _f(a, "xmax"))
            & (_f(b, "ymin") >= _f(a, "ymin")) & (_f(b, "ymax") <= _f(a, "ymax")))
    return flat & F.when(is_3d(a) & is_3d(b), z).otherwise(F.lit(True))


def within(a, b) -> Column:
    """``a`` strictly inside ``b``: no border is shared."""
    z = (_f(a, "zmin") > _f(b, "zmin")) & (_f(a, "zmax") < _f(b, "zmax"))
    flat = ((_f(a, "xmin") > _f(b, "xmin")) & (_f(a, "xmax") < _f(b, "xmax"))
            & (_f(a, "ymin") > _f(b, "ymin")) & (_f(a, "ymax") < _f(b, "ymax")))
    return flat & F.when(is_3d(a) & is_3d(b), z).otherwise(F.lit(True))


def contains_point(e, x: Column, y: Column, z: Column | None = None) -> Column:
    flat = (x >= _f(e, "xmin")) & (x <= _f(e, "xmax")) & (y >= _f(e, "ymin")) & (y <= _f(e, "ymax"))
    if z is None:
        return flat
    return flat & F.when(is_3d(e) & z.isNotNull(), (z >= _f(e, "zmin")) & (z <= _f(e, "zmax"))).otherwise(F.lit(True))


def center(e) -> Column:
    mid = lambda a: ((_f(e, f"{a}min") + _f(e, f"{a}max")) / 2).alias(a)
    return F.struct(mid("x"), mid("y"), mid("z"))


def is_on_tile(e, xmin, ymin, xmax, ymax) -> Column:
    """Centre inside the tile, the lower borders excluded and the upper ones included; plane only."""
    c = center(e)
    x, y = c.getField("x"), c.getField("y")
    return (x > xmin) & (x <= xmax) & (y > ymin) & (y <= ymax)


def include(a, b) -> Column:
    """Smallest box around both; an empty (null) box adds nothing."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    low = lambda n: F.least(_f(a, n), _f(b, n)).alias(n)
    high = lambda n: F.greatest(_f(a, n), _f(b, n)).alias(n)
    both = F.struct(low("xmin"), low("ymin"), low("zmin"), high("xmax"), high("ymax"), high("zmax"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def extent(e) -> Column:
    """Aggregate: the box around all boxes of the group, null if there is none."""
    low = lambda n: F.min(_f(e, n)).alias(n)
    high = lambda n: F.max(_f(e, n)).alias(n)
    out = F.struct(low("xmin"), low("ymin"), low("zmin"), high("xmax"), high("ymax"), high("zmax"))
    return F.when(F.min(_f(e, "xmin")).isNotNull(), out)


def to_polygon(e) -> Column:
    """The box outline as one closed ring, counter-clockwise from the lower corner; 3D boxes use the lower z."""
    def corner(x, y):
        flat = F.array(_f(e, x), _f(e, y))
        return F.when(is_3d(e), F.concat(flat, F.array(_f(e, "zmin")))).otherwise(flat)
    return F.array(F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"),
                           corner("xmin", "ymax"), corner("xmin", "ymin")))


def force_2d(e) -> Column:
    null = F.lit(None).cast("double")
    out = F.struct(*[(null if n[0] == "z" else _f(e, n)).alias(n) for n in FIELDS])
    e = F.col(e) if isinstance(e, str) else e
    return F.when(e.isNotNull(), out)


def expand(e, distance: Column | float) -> Column:
    """The box grown by ``distance`` on every side of the plane."""
    d = F.lit(distance) if not isinstance(distance, Column) else distance
    sign = {"xmin": -1, "ymin": -1, "xmax": 1, "ymax": 1}
    return F.struct(*[(_f(e, n) + d * sign[n] if n in sign else _f(e, n)).alias(n) for n in FIELDS])


def of_points(points: Column) -> Column:
    """The box around an ``array<array<double>>`` of coordinates; z is null if any point is 2D."""
    axis = lambda i: F.transform(points, lambda p: F.get(p, i))
    flat = F.exists(points, lambda p: F.size(p) < 3)
    z = lambda agg: F.when(~flat, agg(axis(2)))
    out = F.struct(F.array_min(axis(0)).alias("xmin"), F.array_min(axis(1)).alias("ymin"),
                   z(F.array_min).alias("zmin"), F.array_max(axis(0)).alias("xmax"),
                   F.array_max(axis(1)).alias("ymax"), z(F.array_max).alias("zmax"))
    return F.when(F.size(points) > 0, out).cast(ENVELOPE)


def fields(e, prefix: str = "") -> Sequence[Column]:
    """The six coordinates as flat columns."""
    return [_f(e, n).alias(prefix + n) for n in FIELDS]
