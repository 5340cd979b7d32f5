"""Joins of boxes and outlines of areas against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from polisframe.model import ModelError
from polisframe.operators.outlines import outlines
from polisframe.operators.spatial_join import spatial_join

BOX = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"


def boxes(rng, n):
    out = []
    for i in range(n):
        x, y = rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))]), rng.uniform(-50, 50)
        w, h = rng.choice([(0, 0), (1, 1), (rng.expovariate(0.3), 0.01), (0.02, rng.expovariate(0.2)), (64, 64), (rng.random(), rng.random())])
        out.append((i, (x, y, None, x + w, y + h, None)))
    return [*out, (n, None), (n + 1, (0.0, None, None, 1.0, 1.0, None)), (n + 2, (2.0, 0.0, None, 1.0, 1.0, None))]


@pytest.mark.parametrize(("distance", "heavy"), [(0.0, 200_000), (0.0, 20), (1.5, 30)])
def test_spatial_join(spark, distance, heavy):
    rng = random.Random(3)
    a, b = boxes(rng, 220), boxes(rng, 180)
    left = spark.createDataFrame(a, f"a bigint, abox {BOX}")
    right = spark.createDataFrame(b, f"b bigint, bbox {BOX}")
    found = spatial_join(left, right, "abox", "bbox", distance, heavy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    ok = lambda p: p is not None and p[1] is not None and p[3] >= p[0] and p[4] >= p[1]
    gap = lambda p, q: math.hypot(max(p[0] - q[3], q[0] - p[3], 0), max(p[1] - q[4], q[1] - p[4], 0))
    want = sorted((i, j) for i, p in a for j, q in b if ok(p) and ok(q) and gap(p, q) <= distance)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want and len(want) > 500


def test_spatial_join_without_rows(spark):
    left = spark.createDataFrame([(1, (0.0, 0.0, None, 1.0, 1.0, None))], f"a bigint, abox {BOX}")
    right = spark.createDataFrame([], f"b bigint, bbox {BOX}")
    assert spatial_join(left, right, "abox", "bbox").collect() == []
    with pytest.raises(ModelError):
        spatial_join(left, left, "abox", "abox")
    with pytest.raises(ModelError):
        spatial_join(left, right, "abox", "bbox", -1)


def parts(cells, neighbours):
    left, count = set(cells), 0
    while left:
        todo, count = [left.pop()], count + 1
        while todo:
            x, y = todo.pop()
            for dx, dy in neighbours:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
    return count


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def test_outlines(spark):
    """Random areas of unit squares, joined by sides; many touch themselves in points and have holes."""
    rng = random.Random(11)
    areas = {}
    for area in range(30):
        cells, edge = {(0, 0)}, [(0, 0)]
        while len(cells) < 60:
            x, y = rng.choice(edge)
            dx, dy = rng.choice(FOUR)
            if abs(x + dx) < 6 and abs(y + dy) < 6 and (x + dx, y + dy) not in cells:
                cells.add((x + dx, y + dy))
                edge.append((x + dx, y + dy))
        areas[area] = cells
    rows = [(a, float(x), float(y), x + 1.0, y + 1.0) for a, cells in areas.items() for x, y in cells]
    rows += [(0, 3.0, 3.0, 3.0, 9.0), (99, 1.0, 1.0, 4.0, 2.0), (99, 1.0, 2.0, 2.0, 3.0)]
    got = {r["a"]: r for r in outlines(spark.createDataFrame(rows, "a int, xmin double, ymin double, xmax double, ymax double").repartition(5), "a").collect()}
    assert set(got) == {*areas, 99} and sum(r["holes"] for r in got.values()) > 10
    for area, cells in areas.items():
        r = got[area]
        empty = {(x, y) for x in range(-8, 9) for y in range(-8, 9)} - cells
        assert r["size"] == 60 and r["holes"] == parts(empty, FOUR) - 1 == len(r["rings"]) - 1
        assert r["length"] == sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in FOUR)
        twice = 0
        for i, ring in enumerate(r["rings"]):
            assert ring[0] == ring[-1] == min(ring) and len({tuple(p) for p in ring[:-1]}) == len(ring) - 1  # no ring touches itself
            own = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
            assert (own > 0) == (i == 0)
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:]))
            twice += own
        assert twice == 120
    assert got[99]["rings"] == [[[1, 1], [4, 1], [4, 2], [2, 2], [2, 3], [1, 3], [1, 1]]]
    assert outlines(spark.createDataFrame([], "a int, xmin double, ymin double, xmax double, ymax double"), "a").collect() == []
