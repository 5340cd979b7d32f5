"""Tile matrices, tile assignment and tile names.

Tile borders are running sums of the tile size, and the last column and row end at the matrix extent. A feature belongs
to the tile its envelope's centre is in; lower borders are open, upper ones closed.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from itertools import accumulate, repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.functions.scalar import convert_length
from polisframe.model import ModelError

TOP_LEFT, BOTTOM_LEFT = "top_left", "bottom_left"


@dataclass(frozen=True)
class TileMatrix:
    xmin: float
    ymin: float
    xmax: float
    ymax: float
    columns: int
    rows: int
    width: float
    height: float
    origin: str = TOP_LEFT

    def column_offsets(self) -> list[float]:
        return list(accumulate(repeat(self.width, self.columns - 1), initial=0.0))

    def row_offsets(self) -> list[float]:
        return list(accumulate(repeat(self.height, self.rows - 1), initial=0.0))

    # borders in x by column, and in y by row counted from the top
    def x_borders(self) -> list[float]:
        return [self.xmin + o for o in self.column_offsets()] + [self.xmax]

    def y_borders(self) -> list[float]:
        return [self.ymax - o for o in self.row_offsets()] + [self.ymin]


def matrix_scheme(extent: tuple[float, float, float, float], columns: int, rows: int,
                  origin: str = TOP_LEFT) -> TileMatrix:
    """Divide the extent (xmin, ymin, xmax, ymax) equally."""
    if columns < 1 or rows < 1:
        raise ModelError("columns and rows must be positive")
    xmin, ymin, xmax, ymax = map(float, extent)
    return TileMatrix(xmin, ymin, xmax, ymax, columns, rows, (xmax - xmin) / columns, (ymax - ymin) / rows, origin)


def dimension_scheme(extent: tuple[float, float, float, float], width: float, height: float,
                     grid_point: tuple[float, float] = (0.0, 0.0), width_unit: str | None = None,
                     height_unit: str | None = None, axis_unit: str = "m", origin: str = TOP_LEFT) -> TileMatrix:
    """Tiles of a fixed size; the lower corner is snapped down to the grid through ``grid_point``."""
    if width <= 0 or height <= 0:
        raise ModelError("tile width and height must be positive")
    w, h = convert_length(width, width_unit, axis_unit), convert_length(height, height_unit, axis_unit)
    xmin, ymin, xmax, ymax = map(float, extent)
    left, bottom = _snap(grid_point[0], xmin, w), _snap(grid_point[1], ymin, h)
    columns, rows = math.ceil((xmax - left) / w), math.ceil((ymax - bottom) / h)
    return TileMatrix(left, bottom, left + columns * w, bottom + rows * h, columns, rows, w, h, origin)


def _snap(grid: float, candidate: float, size: float) -> float:
    """The grid line at or below ``candidate``."""
    return grid + math.floor((candidate - grid) / size) * size


def extent_of(query_extent: DataFrame) -> tuple[float, float, float, float]:
    """The default tiling extent: a one-row extent frame as numbers."""
    e = query_extent.first()["envelope"]
    if e is None:
        raise ModelError("the query has no extent")
    return e["xmin"], e["ymin"], e["xmax"], e["ymax"]


def _row_index(matrix: TileMatrix, row: Column) -> Column:
    """Row number as named <-> row counted from the top (the same formula both ways)."""
    return (matrix.rows - 1 - row) if matrix.origin == BOTTOM_LEFT else row


def tiles(spark: SparkSession, matrix: TileMatrix) -> DataFrame:
    """All tiles with their borders: tile_col, tile_row, xmin, ymin, xmax, ymax."""
    xs, ys = _numbers(matrix.x_borders()), _numbers(matrix.y_borders())
    cells = spark.range(matrix.columns * matrix.rows)
    col = (F.col("id") % matrix.columns).cast("int")
    row = F.floor(F.col("id") / matrix.columns).cast("int")
    top = _row_index(matrix, row)
    at = lambda a, i: F.get(a, i.cast("int"))
    return cells.select(col.alias("tile_col"), row.alias("tile_row"), at(xs, col).alias("xmin"),
                        at(ys, top + 1).alias("ymin"), at(xs, col + 1).alias("xmax"), at(ys, top).alias("ymax"))


def _numbers(values: list[float]) -> Column:
    """A constant array; parsed from text once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def assign_tile(df: DataFrame, matrix: TileMatrix) -> DataFrame:
    """Add tile_col and tile_row; rows without an envelope or outside every tile are dropped.

    The tile is computed, not joined: position divided by size gives a candidate, and the summed borders decide
    between it and its neighbours.
    """
    c = env.center("envelope")
    x, y = c.getField("x"), c.getField("y")
    xs = _numbers(matrix.x_borders())
    # rows run downwards: negate y so that borders ascend; (ymin, ymax] becomes [-ymax, -ymin)
    ys = _numbers([-b for b in matrix.y_borders()])
    col = _between(x, xs, F.ceil((x - matrix.xmin) / matrix.width) - 1, matrix.columns,
                   lambda v, low, high: (v > low) & (v <= high))
    top = _between(-y, ys, F.floor((matrix.ymax - y) / matrix.height), matrix.rows,
                   lambda v, low, high: (v >= low) & (v < high))
    placed = df.withColumn("tile_col", col.cast("int")).withColumn("_top", top.cast("int"))
    placed = placed.where(F.col("tile_col").isNotNull() & F.col("_top").isNotNull())
    return placed.withColumn("tile_row", _row_index(matrix, F.col("_top")).cast("int")).drop("_top")


def _between(value: Column, borders: Column, guess: Column, count: int, inside) -> Column:
    out = F.lit(None).cast("bigint")
    for shift in (1, -1, 0):
        i = (guess + shift).cast("int")
        fits = (i >= 0) & (i < count) & inside(value, F.get(borders, i), F.get(borders, i + 1))
        out = F.when(fits, i).otherwise(out)
    return out


def tile_query(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The features of one tile: box filter first, then the centre rule."""
    return df.where(env.intersects_2d("envelope", env.box(xmin, ymin, xmax, ymax))
                    & env.is_on_tile("envelope", xmin, ymin, xmax, ymax))


_TOKEN = re.compile(r"@(column|row|x_min|y_min|x_max|y_max)(?:,(.+?))?@", re.IGNORECASE)
_TOKEN_COLUMNS = {"column": "tile_col", "row": "tile_row", "x_min": "xmin", "y_min": "ymin", "x_max": "xmax",
                  "y_max": "ymax"}


def tile_name(template: str, single: bool = False) -> Column:
    """Output name of a tile row: tokens ``@column@``, ``@x_min,%.2f@`` …; without tokens the suffix ``_col_row``."""
    parts, last = [], 0
    for match in _TOKEN.finditer(template):
        value = F.col(_TOKEN_COLUMNS[match.group(1).lower()])
        form = (match.group(2) or "%s").strip()
        parts += [F.lit(template[last:match.start()]), F.format_string(form, value)]
        last = match.end()
    if parts or single:
        return F.concat(*parts, F.lit(template[last:]))
    dot = template.rfind(".")
    stem, suffix = (template[:dot], template[dot:]) if dot > 0 else (template, "")
    return F.concat(F.lit(stem + "_"), F.col("tile_col"), F.lit("_"), F.col("tile_row"), F.lit(suffix))


def tile_type_counts(tiled: DataFrame) -> DataFrame:
    """Features per tile and class; empty tiles have no row."""
    return tiled.groupBy("tile_col", "tile_row", "objectclass_id").agg(F.count("*").alias("n"))
