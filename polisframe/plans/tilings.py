"""Tile matrices and tile assignment."""

from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.operators import tiling as tl
from polisframe.operators.query import FeatureQuery
from polisframe.plans.registry import query


def _order_extent(m):
    return tl.extent_of(FeatureQuery(m, ["Order"]).extent())


def _dimension(m, origin=tl.TOP_LEFT):
    return tl.dimension_scheme(_order_extent(m), 128.0, 256.0, origin=origin)


_TILES = """WITH e AS (SELECT min(xmin) x0, min(ymin) y0, max(xmax) x1, max(ymax) y1 FROM feature WHERE objectclass_id = 20),
  d AS (SELECT floor(x0 / 128.0::DOUBLE) * 128 AS left_, floor(y0 / 256.0::DOUBLE) * 256 AS bottom, x1, y1 FROM e),
  s AS (SELECT left_, bottom, CAST(ceil((x1 - left_) / 128.0::DOUBLE) AS INTEGER) AS columns,
    CAST(ceil((y1 - bottom) / 256.0::DOUBLE) AS INTEGER) AS rows FROM d),
  tiles AS (SELECT c AS tile_col, r AS tile_row, CAST(left_ + c * 128 AS DOUBLE) AS xmin,
    CAST(bottom + (rows - 1 - r) * 256 AS DOUBLE) AS ymin, CAST(left_ + (c + 1) * 128 AS DOUBLE) AS xmax,
    CAST(bottom + (rows - r) * 256 AS DOUBLE) AS ymax, rows
    FROM s, (SELECT unnest(range(0, (SELECT columns FROM s)))::INTEGER AS c),
      (SELECT unnest(range(0, (SELECT rows FROM s)))::INTEGER AS r)),
  centred AS (SELECT *, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM feature)"""
_ON = "cx > t.xmin AND cx <= t.xmax AND cy > t.ymin AND cy <= t.ymax"

query("tile_dimension_matrix", f"{_TILES} SELECT tile_col, tile_row, xmin, ymin, xmax, ymax FROM tiles")(
    lambda m: tl.tiles(m.spark, _dimension(m)))
query("tile_matrix_equal", """WITH e AS (
    SELECT min(xmin) x0, min(ymin) y0, max(xmax) x1, max(ymax) y1 FROM feature WHERE objectclass_id = 20)
    SELECT c::INTEGER AS tile_col, r::INTEGER AS tile_row, round(x0 + c * (x1 - x0) / 8, 6) AS xmin,
      round(y1 - (r + 1) * (y1 - y0) / 4, 6) AS ymin, round(x0 + (c + 1) * (x1 - x0) / 8, 6) AS xmax,
      round(y1 - r * (y1 - y0) / 4, 6) AS ymax
    FROM e, (SELECT unnest(range(0, 8)) AS c), (SELECT unnest(range(0, 4)) AS r)""")(
    lambda m: tl.tiles(m.spark, tl.matrix_scheme(_order_extent(m), 8, 4)).select(
        "tile_col", "tile_row", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
query("assign_tile", f"""{_TILES} SELECT f.id, tile_col, tile_row FROM centred f JOIN tiles t ON {_ON}
    WHERE objectclass_id IN (10, 11, 20)""")(
    lambda m: tl.assign_tile(FeatureQuery(m, ["Order", "Customer", "Supplier"]).result("envelope"),
                             _dimension(m)).select("id", "tile_col", "tile_row"))
query("assign_tile_bottom_left", f"""{_TILES} SELECT f.id, tile_col, rows - 1 - tile_row AS tile_row
    FROM centred f JOIN tiles t ON {_ON} WHERE objectclass_id = 20""")(
    lambda m: tl.assign_tile(FeatureQuery(m, ["Order"]).result("envelope"),
                             _dimension(m, tl.BOTTOM_LEFT)).select("id", "tile_col", "tile_row"))
query("tile_type_counts", f"""{_TILES} SELECT tile_col, tile_row, objectclass_id, count(*) AS n
    FROM centred f JOIN tiles t ON {_ON} GROUP BY 1, 2, 3""")(
    lambda m: tl.tile_type_counts(tl.assign_tile(m.feature, _dimension(m))))
query("tile_query", """SELECT id FROM feature WHERE objectclass_id = 20 AND (xmin + xmax) / 2 > 128
    AND (xmin + xmax) / 2 <= 256 AND (ymin + ymax) / 2 > 256 AND (ymin + ymax) / 2 <= 512""")(
    lambda m: tl.tile_query(FeatureQuery(m, ["Order"]).result("envelope"), 128, 256, 256, 512).select("id"))
query("tile_default_extent", """SELECT min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin, max(xmax) AS xmax,
    max(ymax) AS ymax, max(zmax) AS zmax FROM feature WHERE objectclass_id = 20""")(
    lambda m: FeatureQuery(m, ["Order"]).extent().select(*env.fields("envelope")))
query("tile_names", f"""{_TILES} SELECT DISTINCT tile_col, tile_row,
      'out/tile_' || tile_col || '_' || printf('%.1f', t.xmin) || '.json' AS name,
      'model_' || tile_col || '_' || tile_row || '.gml' AS default_name
    FROM tiles t JOIN centred f ON {_ON} AND objectclass_id = 20""")(
    lambda m: tl.assign_tile(FeatureQuery(m, ["Order"]).result("envelope"), _dimension(m))
    .select("tile_col", "tile_row").distinct().join(tl.tiles(m.spark, _dimension(m)), ["tile_col", "tile_row"])
    .select("tile_col", "tile_row", tl.tile_name("out/tile_@column@_@x_min,%.1f@.json").alias("name"),
            tl.tile_name("model.gml").alias("default_name")))
