"""Clustering boxes by transitive intersection, and the exact union of each cluster.

Boxes are cut by a grid that is refined only where it is crowded. In a crowded cell

* a box that covers the cell meets every other box there: one edge each to that box, and the cell is finished;
* of boxes with the same part inside the cell, or that cut it along one side only, one stands for the others;
* what is left goes on to the four quarters of the cell.

Cells end with at most ``LEAF`` boxes, and only there boxes are compared with each other. So the work is linear in the
number of boxes even if very many of them lie on one spot; no box is dropped, edges keep them connected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisframe.operators.components import components
from polisframe.runtime import checkpointed

LEAF = 32
#: Refinements below the first grid; a cell this small that is still crowded is compared as it is.
MAX_REFINEMENTS = 24
_COORDS = ["xmin", "ymin", "xmax", "ymax"]


def cluster_boxes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and pieces of all clusters of ``boxes`` (id, xmin, ymin, xmax, ymax; no nulls).

    Members: (id, cluster_id, region_id). A cluster joins boxes that share any point, a region those that share more
    than a point, which is one polygon of the union. Pieces: (region_id, xmin, ymin, xmax, ymax), rectangles that do
    not overlap and together are the region.
    """
    # boxes with equal coordinates are one box from here on
    same = boxes.groupBy(*_COORDS).agg(F.min("id").alias("rep"))
    distinct = checkpointed(same)
    leaves, covered, edges = _refine(distinct)
    pairs = _leaf_pairs(leaves)
    edges = checkpointed(edges.unionByName(pairs))
    clusters = components(edges.select("a", "b")).withColumnsRenamed({"id": "rep", "component": "cluster_id"})
    regions = components(edges.where("solid").select("a", "b")).withColumnsRenamed(
        {"id": "rep", "component": "region_id"})
    labelled = distinct.join(clusters, "rep", "left").join(regions, "rep", "left").select(
        *_COORDS, "rep", F.coalesce("cluster_id", "rep").alias("cluster_id"),
        F.coalesce("region_id", "rep").alias("region_id"))
    labelled = checkpointed(labelled)
    members = boxes.join(labelled.select(*_COORDS, "cluster_id", "region_id"), _COORDS)
    pieces = _pieces(leaves, covered, labelled.select("rep", "region_id"))
    return members.select("id", "cluster_id", "region_id"), pieces


def _refine(distinct: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaf rows (cell, box), covered cells (cell, box), and edges found on the way."""
    grid = _grid(distinct)
    if grid is None:
        rows = distinct.withColumns({c: F.lit(None).cast("bigint") for c in ("level", "i", "j")}).withColumns(
            {f"c_{c}": F.lit(None).cast("double") for c in _COORDS}).limit(0)
        edges = rows.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("solid"))
        return rows, rows, edges
    level = grid["level"]
    rows = checkpointed(_cut(distinct, grid, level))
    leaves, covered, edges = [], [], []
    for step in range(MAX_REFINEMENTS + 1):
        cell = ["i", "j"]
        counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
        crowded = counts.where(F.col("n") > LEAF).select(*cell)
        crowded = checkpointed(crowded)
        if step == MAX_REFINEMENTS or crowded.isEmpty():
            leaves.append(rows)
            break
        leaves.append(rows.join(crowded, cell, "left_anti"))
        hot = rows.join(crowded, cell, "left_semi")
        kept, cover, found = _thin(hot)
        covered.append(cover)
        edges.append(found)
        level += 1
        rows = checkpointed(_cut(kept.select("rep", *_COORDS, F.col("i").alias("pi"), F.col("j").alias("pj")), grid,
                                 level))
    return _union(leaves), _union(covered) if covered else leaves[0].limit(0), _union(edges) if edges else _no_edges(
        leaves[0])


def _no_edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("solid")).limit(0)


def _grid(distinct: DataFrame) -> dict | None:
    """Extent and first grid level: the finest on which boxes meet at most four cells on average."""
    width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    bounds = distinct.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax"), F.count("*")).first()
    x0, y0, x1, y1, n = bounds
    if n == 0:
        return None
    side_x, side_y = max(x1 - x0, 1e-9), max(y1 - y0, 1e-9)
    levels = range(0, 21)
    load = distinct.agg(*[
        F.sum((width / (side_x / 2 ** d) + 1) * (height / (side_y / 2 ** d) + 1)).alias(str(d)) for d in levels
    ]).first()
    best = 0
    for d in levels:
        if load[str(d)] <= 4 * n and 4 ** d <= 4 * max(1, n // LEAF):
            best = d
    return {"x0": x0, "y0": y0, "sx": side_x, "sy": side_y, "level": best}


def _cut(rows: DataFrame, grid: dict, level: int) -> DataFrame:
    """One row per box and closed cell of the level it meets, with the part of the box inside.

    With ``pi`` and ``pj`` (a cell of the level above) only that cell's quarters are used.
    """
    count = 2 ** level
    gx, gy = grid["sx"] / count, grid["sy"] / count

    def span(low, high, start, size, parent):
        first = F.greatest(F.floor((F.col(low) - start) / size) - 1, F.lit(0))
        last = F.least(F.floor((F.col(high) - start) / size) + 1, F.lit(count - 1))
        if parent in rows.columns:
            first, last = F.greatest(first, F.col(parent) * 2), F.least(last, F.col(parent) * 2 + 1)
        every = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        # the margin of one cell guards against rounding; the exact borders decide
        return F.filter(every, lambda k: (F.col(low) <= start + (k + 1) * size) & (F.col(high) >= start + k * size))

    out = rows.withColumn("i", F.explode(span("xmin", "xmax", grid["x0"], gx, "pi")))
    out = out.withColumn("j", F.explode(span("ymin", "ymax", grid["y0"], gy, "pj")))
    at = lambda start, size, k: F.lit(start) + k * size
    left, bottom = at(grid["x0"], gx, F.col("i")), at(grid["y0"], gy, F.col("j"))
    right, top = at(grid["x0"], gx, F.col("i") + 1), at(grid["y0"], gy, F.col("j") + 1)
    return out.select(
        "rep", *_COORDS, F.lit(level).cast("bigint").alias("level"), "i", "j",
        F.greatest("xmin", left).alias("c_xmin"), F.greatest("ymin", bottom).alias("c_ymin"),
        F.least("xmax", right).alias("c_xmax"), F.least("ymax", top).alias("c_ymax"),
        (F.col("xmin") <= left).alias("at_left"), (F.col("xmax") >= right).alias("at_right"),
        (F.col("ymin") <= bottom).alias("at_bottom"), (F.col("ymax") >= top).alias("at_top"))


def _box(names=("rep", *_COORDS)) -> Column:
    return F.struct(*names)


def _edge(df: DataFrame, other: Column) -> DataFrame:
    """Edges from each row's box to ``other``; solid if they share more than a point."""
    wide = F.least("xmax", other["xmax"]) > F.greatest("xmin", other["xmin"])
    high = F.least("ymax", other["ymax"]) > F.greatest("ymin", other["ymin"])
    return df.select(F.col("rep").alias("a"), other["rep"].alias("b"), (wide | high).alias("solid"))


def _thin(hot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crowded cells: rows to refine, covered cells with one covering box, edges for the rows left behind."""
    cell = ["i", "j"]
    clip = [*cell, "c_xmin", "c_ymin", "c_xmax", "c_ymax"]
    flags = [F.col(c) for c in ("at_left", "at_right", "at_bottom", "at_top")]
    left, right, bottom, top = flags
    # side: which half of the cell a one-sided box fills (4 kinds), or all of it
    side = (F.when(left & right & bottom & top, "all").when(left & bottom & top, "left")
            .when(right & bottom & top, "right").when(left & right & bottom, "bottom").when(left & right & top, "top"))
    reach = (F.when(F.col("side") == "left", F.col("c_xmax")).when(F.col("side") == "right", -F.col("c_xmin"))
             .when(F.col("side") == "bottom", F.col("c_ymax")).when(F.col("side") == "top", -F.col("c_ymin"))
             .otherwise(0.0))
    hot = hot.withColumn("side", side)
    sided = hot.where("side is not null").groupBy(*cell, "side").agg(
        F.max_by(_box(), F.struct(reach, -F.col("rep"))).alias("best"))
    sided = checkpointed(sided)
    cover = sided.where("side = 'all'").select(*cell, F.col("best").alias("cover"))
    in_covered = hot.join(cover, cell)
    covered = in_covered.where(F.col("rep") == F.col("cover.rep")).drop("side", "cover")
    edges = [_edge(in_covered.where(F.col("rep") != F.col("cover.rep")), F.col("cover"))]
    open_ = hot.join(cover, cell, "left_anti")
    half = open_.where("side is not null").join(sided, [*cell, "side"])
    edges.append(_edge(half.where(F.col("rep") != F.col("best.rep")), F.col("best")))
    kept_half = half.where(F.col("rep") == F.col("best.rep")).drop("best")
    rest = open_.where("side is null")
    alike = rest.groupBy(*clip).agg(F.min(_box()).alias("best"))
    rest = rest.join(alike, clip)
    edges.append(_edge(rest.where(F.col("rep") != F.col("best.rep")), F.col("best")))
    kept = kept_half.unionByName(rest.where(F.col("rep") == F.col("best.rep")).drop("best")).drop("side")
    return kept, covered, checkpointed(_union(edges))


def _leaf_pairs(leaves: DataFrame) -> DataFrame:
    """Edges between boxes that meet inside one leaf cell, which has at most ``LEAF`` boxes."""
    key = ["level", "i", "j"]
    a = leaves.select(*key, _box().alias("x"))
    b = leaves.select(*key, "rep", *_COORDS)
    meet = ((F.col("xmin") <= F.col("x.xmax")) & (F.col("xmax") >= F.col("x.xmin"))
            & (F.col("ymin") <= F.col("x.ymax")) & (F.col("ymax") >= F.col("x.ymin")) & (F.col("rep") > F.col("x.rep")))
    return _edge(b.join(a, key).where(meet), F.col("x")).groupBy("a", "b").agg(F.max("solid").alias("solid"))


def _pieces(leaves: DataFrame, covered: DataFrame, regions: DataFrame) -> DataFrame:
    """Rectangles without overlap: covered cells as they are, leaf cells cut into vertical slabs."""
    whole = covered.join(regions, "rep").select("region_id", *[F.col(f"c_{c}").alias(c) for c in _COORDS])
    key = ["level", "i", "j", "region_id"]
    clips = leaves.where("c_xmax > c_xmin and c_ymax > c_ymin").join(regions, "rep").select(
        *key, "c_xmin", "c_ymin", "c_xmax", "c_ymax")
    borders = clips.select(*key, F.explode(F.array("c_xmin", "c_xmax")).alias("x")).distinct()
    slabs = borders.withColumn("x2", F.lead("x").over(Window.partitionBy(*key).orderBy("x"))).where("x2 is not null")
    parts = slabs.join(clips, key).where("c_xmin <= x and c_xmax >= x2").select(*key, "x", "x2", "c_ymin", "c_ymax")
    slab = Window.partitionBy(*key, "x").orderBy("c_ymin", "c_ymax")
    seen = F.max("c_ymax").over(slab.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("starts", F.when(seen.isNull() | (F.col("c_ymin") > seen), 1).otherwise(0))
    parts = parts.withColumn("run", F.sum("starts").over(slab.rowsBetween(Window.unboundedPreceding, 0)))
    cut = parts.groupBy(*key, "x", "x2", "run").agg(F.min("c_ymin").alias("ymin"), F.max("c_ymax").alias("ymax"))
    return whole.unionByName(cut.select("region_id", F.col("x").alias("xmin"), "ymin", F.col("x2").alias("xmax"),
                                        "ymax"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
