"""Coordinate functions: affine maps, template placement, flattening of geometry trees."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.model import ModelError

SWAP_XY = (0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def _matrix(matrix: str | Sequence[float]) -> tuple[float, ...]:
    values = SWAP_XY if isinstance(matrix, str) and matrix == "swap-xy" else tuple(map(float, matrix))
    if len(values) not in (12, 16):
        raise ModelError("an affine matrix has 12 numbers (3 rows of 4), or 16")
    return values[:12]


def _apply(m, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Row-major 3 × 4 map; ``m`` is indexable (numbers or Columns)."""
    row = lambda i: x * m[i] + y * m[i + 1] + z * m[i + 2] + m[i + 3]
    return row(0), row(4), row(8)


def transform_point(point: Column, matrix) -> Column:
    """A coordinate array through the map; a 2D point counts as z = 0 and stays 2D."""
    m = _matrix(matrix)
    flat = F.size(point) < 3
    x, y, z = _apply(m, F.get(point, 0), F.get(point, 1), F.when(flat, 0.0).otherwise(F.get(point, 2)))
    return F.when(flat, F.array(x, y)).otherwise(F.array(x, y, z))


def transform_primitives(primitives: Column, matrix) -> Column:
    """All coordinates of ``primitives`` (array of primitives, rings, points) through the map."""
    return F.transform(primitives, lambda p: F.transform(p, lambda ring: F.transform(
        ring, lambda pt: transform_point(pt, matrix))))


def _box_image(e, m) -> Column:
    """The box around the image of a box. An axis of the image is a sum over the axes of the box, so its extremes are sums of the
    extremes of the terms; no corner is computed."""
    f = lambda n: env._f(e, n)
    flat = ~env.is_3d(e)
    sides = [(f("xmin"), f("xmax")), (f("ymin"), f("ymax")), tuple(F.when(flat, 0.0).otherwise(f(n)) for n in ("zmin", "zmax"))]

    def along(i, pick):
        x, y, z = (pick(low * m[4 * i + j], high * m[4 * i + j]) for j, (low, high) in enumerate(sides))
        return x + y + z + m[4 * i + 3]

    solid = lambda c: F.when(~flat, c)
    return F.struct(along(0, F.least).alias("xmin"), along(1, F.least).alias("ymin"), solid(along(2, F.least)).alias("zmin"),
                    along(0, F.greatest).alias("xmax"), along(1, F.greatest).alias("ymax"), solid(along(2, F.greatest)).alias("zmax"))


def transform_envelope(e, matrix) -> Column:
    column = F.col(e) if isinstance(e, str) else e
    return F.when(column.isNotNull(), _box_image(column, _matrix(matrix)))


def template_envelope(box: Column, matrix: Column, reference: Column) -> Column:
    """Where a template's box lands: its image under the matrix, moved to the reference point.

    ``matrix`` is a 16-number array column, ``reference`` a coordinate array. Without a box (library object) it is the
    placed point alone; without matrix or reference point it is null.
    """
    at = lambda i: F.get(matrix, i)
    ref = lambda i: F.get(reference, i)
    m = [at(i) + (ref(i // 4) if i % 4 == 3 else F.lit(0.0)) for i in range(12)]
    spot = lambda i: at(4 * i + 3) + ref(i)
    point = F.struct(*[spot(i).alias(n) for n, i in
                       (("xmin", 0), ("ymin", 1), ("zmin", 2), ("xmax", 0), ("ymax", 1), ("zmax", 2))])
    placed = F.when(box.isNull(), point).otherwise(_box_image(box, m))
    return F.when(matrix.isNotNull() & reference.isNotNull(), placed)


def envelope_of(primitives: Column) -> Column:
    """The box around all coordinates of a geometry."""
    return env.of_points(F.flatten(F.flatten(primitives)))


def affine_transform(df: DataFrame, matrix, geometry: str = "primitives", envelope: str = "envelope") -> DataFrame:
    """Apply the map to the geometry and envelope columns the frame has."""
    out = df
    if geometry in df.columns:
        out = out.withColumn(geometry, transform_primitives(F.col(geometry), matrix))
    if envelope in df.columns:
        out = out.withColumn(envelope, transform_envelope(F.col(envelope), matrix))
    return out


def flatten_geometry(geometries: DataFrame) -> DataFrame:
    """One row per node of each geometry tree: position, type, object id, parent position and, on leaves, rings."""
    keep = [c for c in geometries.columns if c not in ("nodes", "primitives")]
    nodes = geometries.select(*keep, "primitives", F.posexplode("nodes").alias("pos", "node"))
    return nodes.select(
        *keep, "pos", "node.type", "node.object_id", "node.parent", "node.geometry_index", "node.is_reversed",
        F.get("primitives", F.col("node.geometry_index")).alias("rings"))


def rebuild_geometry(nodes: DataFrame) -> DataFrame:
    """The inverse of :func:`flatten_geometry`: one row per geometry id, nodes and primitives in tree order.

    A group is the tree of one geometry, which one row holds anyway.
    """
    entry = F.struct("pos", "type", "object_id", "parent", "geometry_index", "is_reversed", "rings")
    grouped = nodes.groupBy("id", "feature_id", "geometry_type").agg(F.array_sort(F.collect_list(entry)).alias("n"))
    leaves = F.array_sort(F.transform(
        F.filter("n", lambda x: x["geometry_index"].isNotNull()),
        lambda x: F.struct(x["geometry_index"].alias("i"), x["rings"].alias("r"))))
    return grouped.select(
        "id", "feature_id", "geometry_type",
        F.transform("n", lambda x: F.struct(
            x["type"].alias("type"), x["object_id"].alias("object_id"), x["parent"].alias("parent"),
            x["geometry_index"].alias("geometry_index"), x["is_reversed"].alias("is_reversed"))).alias("nodes"),
        F.transform(leaves, lambda x: x["r"]).alias("primitives"))
