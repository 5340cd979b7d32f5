"""Pairs of boxes of two tables that meet, as an equi-join on the cells of grids of several levels.

A box belongs to the level whose cells are just as wide as its longer side, so it meets at most four cells of its own or any coarser level. Two
boxes are looked for at the coarser of their levels: a row is sent to the cells of its own level and of those coarser levels that the other
table uses. A pair shares up to four cells and is counted in one, the cell of its reference point (the lower corner of the overlap), so nothing has to
be made distinct. Cells with many candidate pairs are cut by quantiles of the boxes in them into up to ``CUTS`` x ``CUTS`` parts,
and the reference point decides again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.model import ModelError
from polisframe.runtime import checkpointed

#: Candidate pairs of a cell from which on it is cut, and the parts on each axis.
HEAVY, CUTS = 200_000, 16
_FINEST, _COARSEST = -20, 60
_CELL = ["_level", "_i", "_j"]


def _placed(df: DataFrame, box: str, grow: float) -> DataFrame:
    """The rows with a box, its borders and its level."""
    f = lambda n: F.col(box).getField(n)
    out = df.where(f("xmin").isNotNull() & f("ymin").isNotNull() & (f("xmax") >= f("xmin")) & (f("ymax") >= f("ymin"))).select(
        "*", (f("xmin") - grow).alias("_x0"), (f("ymin") - grow).alias("_y0"), (f("xmax") + grow).alias("_x1"), (f("ymax") + grow).alias("_y1"))
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(2.0 ** _FINEST))
    return out.withColumn("_own", F.least(F.ceil(F.log2(side)), F.lit(_COARSEST)).cast("int"))


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("_own").distinct().collect())  # a row a level, 81 at most


def _celled(df: DataFrame, other: list[int]) -> DataFrame:
    """One row per box and cell of its level and of the coarser levels of the other table."""
    coarser = F.filter(F.array(*[F.lit(v) for v in other]), lambda v: v > F.col("_own"))
    out = df.withColumn("_level", F.explode(F.concat(F.array("_own"), coarser)))
    size = F.pow(F.lit(2.0), F.col("_level"))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    return out.withColumn("_i", span("_x0", "_x1")).withColumn("_j", span("_y0", "_y1"))


def _heavy(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(cell, borders on both axes) of the cells with more than ``most`` candidate pairs."""
    counts = lambda df, n: df.groupBy(*_CELL).agg(F.count("*").alias(n))
    cells = counts(left, "a").join(counts(right, "b"), _CELL).where(F.col("a") * F.col("b") > most).select(*_CELL)
    both = left.select(*_CELL, "_x0", "_y0").unionByName(right.select(*_CELL, "_x0", "_y0")).join(cells, _CELL, "left_semi")
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    return both.groupBy(*_CELL).agg(*[F.array_distinct(F.percentile_approx(c, shares, F.lit(1000))).alias(to) for c, to in (("_x0", "_xs"), ("_y0", "_ys"))])


def _part(borders: str, value: Column) -> Column:
    """How many borders are at or below the value; 0 in cells that are not cut."""
    return F.coalesce(F.size(F.filter(F.col(borders), lambda b: b <= value)), F.lit(0))


def _cut(df: DataFrame, heavy: DataFrame) -> DataFrame:
    out = df.join(heavy, _CELL, "left")
    for low, high, borders, to in (("_x0", "_x1", "_xs", "_p"), ("_y0", "_y1", "_ys", "_q")):
        out = out.withColumn(to, F.explode(F.sequence(_part(borders, F.col(low)), _part(borders, F.col(high)))))
    return out


def spatial_join(left: DataFrame, right: DataFrame, left_box: str = "envelope", right_box: str = "envelope", distance: float = 0.0, heavy: int = HEAVY) -> DataFrame:
    """Pairs of rows whose boxes share a point in the plane, or are at most ``distance`` apart.

    The columns of both sides, which must not share names; rows without a box meet nothing.
    """
    if set(left.columns) & set(right.columns):
        raise ModelError("the two sides share column names")
    if distance < 0:
        raise ModelError("a distance is not negative")
    a, b = _placed(left, left_box, float(distance)), _placed(right, right_box, 0.0)
    a_levels, b_levels = _levels(a), _levels(b)
    # either table may be the coarser one; equal levels meet at their own
    a, b = checkpointed(_celled(a, b_levels)), checkpointed(_celled(b, a_levels))
    crowded = checkpointed(_heavy(a, b, heavy))  # few cells: each has that many candidates
    key = [*_CELL, "_p", "_q"]
    mine, theirs = _cut(a, crowded), _cut(b, crowded).drop("_xs", "_ys")
    theirs = theirs.withColumnsRenamed({c: f"{c}b" for c in ("_x0", "_y0", "_x1", "_y1", "_own")})
    x, y = F.greatest("_x0", "_x0b"), F.greatest("_y0", "_y0b")
    size = F.pow(F.lit(2.0), F.col("_level"))
    once = ((F.floor(x / size) == F.col("_i")) & (F.floor(y / size) == F.col("_j")) & (_part("_xs", x) == F.col("_p")) & (_part("_ys", y) == F.col("_q")))
    meet = (F.col("_x0") <= F.col("_x1b")) & (F.col("_x1") >= F.col("_x0b")) & (F.col("_y0") <= F.col("_y1b")) & (F.col("_y1") >= F.col("_y0b"))
    pairs = mine.join(theirs, key).where((F.col("_level") == F.greatest("_own", "_ownb")) & meet & once)
    if distance:
        pairs = pairs.where(box_distance(left_box, right_box) <= distance)
    return pairs.select(*left.columns, *right.columns)


def box_distance(a: Column | str, b: Column | str) -> Column:
    """The distance of two boxes in the plane, 0 if they meet."""
    gap = lambda low, high: F.greatest(env._f(a, low) - env._f(b, high), env._f(b, low) - env._f(a, high), F.lit(0.0))
    return F.hypot(gap("xmin", "xmax"), gap("ymin", "ymax"))
