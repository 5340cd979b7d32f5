"""Exact spatial predicates of stored geometries and envelopes with literal shapes."""

from pyspark.sql import functions as F

from polisframe.functions import spatial as sp
from polisframe.plans.registry import query

_RECT = ("Polygon", [[(200, 300), (420, 300), (420, 520), (200, 520), (200, 300)]])
_CX, _CY, _R = 400, 400, 150
_DIAMOND = ("Polygon", [[(_CX + _R, _CY), (_CX, _CY + _R), (_CX - _R, _CY), (_CX, _CY - _R), (_CX + _R, _CY)]])
_LINE = ("LineString", [(100, 350), (700, 350)])
_POINT = ("Point", (410, 410))


def _geometry():
    return sp.geometry_shape(F.col("geometry_type"), F.col("primitives"))


def _rows(m, name, literal, negate=False, swap=False):
    a, b = _geometry(), sp.literal_shape(*literal)
    if swap:
        a, b = b, a
    return m.geometry_data.where(sp.predicate(name, a, b, negate)).select("id")


_IN = "xmin < 420 AND xmax > 200 AND ymin < 520 AND ymax > 300"
_MEET = "xmin <= 420 AND xmax >= 200 AND ymin <= 520 AND ymax >= 300"
_WITHIN = "xmin >= 200 AND xmax <= 420 AND ymin >= 300 AND ymax <= 520"
_DX = f"greatest(xmin - {_CX}, 0, {_CX} - xmax)"
_DY = f"greatest(ymin - {_CY}, 0, {_CY} - ymax)"
_CORNERS = " AND ".join(f"abs({x} - {_CX}) + abs({y} - {_CY}) <= {_R}" for x in ("xmin", "xmax") for y in ("ymin", "ymax"))

for _name, _pred, _lit, _where, _neg in (
    ("s_intersects", "intersects", _RECT, _MEET, False),
    ("s_disjoint", "disjoint", _RECT, f"NOT ({_MEET})", False),
    ("s_not_intersects", "intersects", _RECT, f"NOT ({_MEET})", True),
    ("s_within", "within", _RECT, _WITHIN, False),
    ("s_touches", "touches", _RECT, f"({_MEET}) AND NOT ({_IN})", False),
    ("s_overlaps", "overlaps", _RECT, f"({_IN}) AND NOT ({_WITHIN})", False),
    ("s_not_overlaps", "overlaps", _RECT, f"NOT (({_IN}) AND NOT ({_WITHIN}))", True),
    ("s_intersects_diamond", "intersects", _DIAMOND, f"{_DX} + {_DY} <= {_R}", False),
    ("s_within_diamond", "within", _DIAMOND, _CORNERS, False),
    ("s_touches_diamond", "touches", _DIAMOND, f"{_DX} + {_DY} = {_R}", False),
    ("s_overlaps_diamond", "overlaps", _DIAMOND, f"{_DX} + {_DY} < {_R} AND NOT ({_CORNERS})", False),
    ("s_intersects_line", "intersects", _LINE, "ymin <= 350 AND ymax >= 350 AND xmin <= 700 AND xmax >= 100", False),
    ("s_crosses_line", "crosses", _LINE, "ymin < 350 AND ymax > 350 AND xmin < 700 AND xmax > 100", False),
    ("s_touches_line", "touches", _LINE, """ymin <= 350 AND ymax >= 350 AND xmin <= 700 AND xmax >= 100
        AND NOT (ymin < 350 AND ymax > 350 AND xmin < 700 AND xmax > 100)""", False),
    ("s_contains_point", "contains", _POINT, "xmin < 410 AND xmax > 410 AND ymin < 410 AND ymax > 410", False),
    ("s_intersects_point", "intersects", _POINT, "xmin <= 410 AND xmax >= 410 AND ymin <= 410 AND ymax >= 410", False),
):
    def _register(name=_name, pred=_pred, lit=_lit, where=_where, neg=_neg):
        query(name, f"SELECT id FROM geometry_data WHERE {where}")(lambda m: _rows(m, pred, lit, neg))
    _register()

query("s_contains", f"SELECT id FROM geometry_data WHERE {_WITHIN}")(lambda m: _rows(m, "contains", _RECT, swap=True))
query("s_equals", """WITH one AS (SELECT * FROM geometry_data WHERE id = (SELECT min(id) FROM geometry_data WHERE geometry_type = 8))
    SELECT g.id FROM geometry_data g JOIN one ON g.xmin = one.xmin AND g.ymin = one.ymin AND g.xmax = one.xmax
      AND g.ymax = one.ymax""")(lambda m: _same(m))


def _same(m):
    first = m.geometry_data.where("geometry_type = 8").orderBy("id").select("primitives").first()[0]
    ring = [tuple(p[:2]) for p in first[0][0]]
    ring = [*ring[1:], ring[1]][::-1]  # other start, other direction
    middle = ((ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2)
    shape = ("Polygon", [[ring[0], middle, *ring[1:]]])  # and one vertex more
    return _rows(m, "equals", shape)


_GAP = "sqrt(pow(greatest(xmin - 420, 0, 200 - xmax), 2) + pow(greatest(ymin - 520, 0, 300 - ymax), 2))"
query("s_dwithin", f"SELECT id FROM geometry_data WHERE {_GAP} <= 25")(
    lambda m: m.geometry_data.where(sp.dwithin(_geometry(), sp.literal_shape(*_RECT), 25)).select("id"))
query("s_dwithin_unit", f"SELECT id FROM geometry_data WHERE {_GAP} <= 25.4")(
    lambda m: m.geometry_data.where(sp.dwithin(_geometry(), sp.literal_shape(*_RECT), 1000, "in")).select("id"))
query("s_beyond", f"SELECT id FROM geometry_data WHERE {_GAP} > 25")(
    lambda m: m.geometry_data.where(sp.beyond(_geometry(), sp.literal_shape(*_RECT), 25)).select("id"))
query("s_envelope_operand", f"SELECT id FROM feature WHERE {_DX} + {_DY} <= {_R} AND xmin IS NOT NULL")(
    lambda m: m.feature.where(sp.intersects(sp.box_shape("envelope"), sp.literal_shape(*_DIAMOND))).select("id"))
query("s_path_geometry", f"""SELECT DISTINCT p.feature_id AS id FROM property p JOIN geometry_data g ON g.id = p.val_geometry_id
    WHERE name = 'geometry' AND val_lod = '2' AND {_DX} + {_DY} <= {_R}""")(
    lambda m: m.property.where("name = 'geometry' and val_lod = '2'").select("feature_id", F.col("val_geometry_id").alias("id"))
    .join(m.geometry_data.where(sp.intersects(_geometry(), sp.literal_shape(*_DIAMOND))).select("id"), "id")
    .select(F.col("feature_id").alias("id")).distinct())
