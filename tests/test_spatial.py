"""Distances, polygons, hulls and neighbours against brute force over all pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.operators import distance, hulls, kdtree, polygons

# --- distance to the nearest cell ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("strip", "size"), [(128, (1.0, 1.0)), (4, (1.0, 1.0)), (7, (2.5, 0.5))])
def test_distance_at_any_range(spark, monkeypatch, strip, size):
    monkeypatch.setattr(distance, "STRIP", strip)
    rng = np.random.default_rng(strip)
    targets = [(int(a), int(b)) for a, b in rng.integers(-30, 30, (25, 2))] + [(500, -700), (500, -700)]
    cells = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(-60, 60, (300, 2)))] + [(300, 5000, 3), (301, None, 3), (302, 1, None), (303, *targets[0]), (304, *targets[0])]
    got = distance.distance_to_nearest(
        spark.createDataFrame(cells, "id long, x long, y long").repartition(3), spark.createDataFrame([*targets, (None, 1)], "x long, y long").repartition(3), size=size
    ).collect()
    assert len(got) == len(cells)
    for r in got:
        if r["x"] is None or r["y"] is None:
            assert r["distance"] is None
        else:
            assert r["distance"] == pytest.approx(min(np.hypot((r["x"] - a) * size[0], (r["y"] - b) * size[1]) for a, b in targets), abs=1e-9)


def test_distance_without_targets_or_cells(spark):
    cells = spark.createDataFrame([(1, 2)], "x long, y long")
    assert distance.distance_to_nearest(cells, cells.limit(0)).collect()[0]["distance"] is None
    assert distance.distance_to_nearest(cells.limit(0), cells).collect() == []


# --- polygons ------------------------------------------------------------------------------------------------------


def random_polygon(rng):
    """A star-shaped ring, sometimes with a hole inside."""
    n, c = int(rng.integers(6, 12)), rng.uniform(-20, 20, 2)
    angle, reach = (np.arange(n) + rng.uniform(0, 0.6, n)) * 2 * np.pi / n, rng.uniform(5, 15, n)
    outer = c + np.stack([np.cos(angle), np.sin(angle)], 1) * reach[:, None]
    rings = [outer.tolist()]
    if rng.random() < 0.5:
        a = c + rng.uniform(-0.4, 0.4, 2)
        rings.append([a.tolist(), [a[0], a[1] + 1.5], [a[0] + 1.5, a[1] + 1.5], [a[0] + 1.5, a[1]]])
    return rings


def even_odd(rings, x, y):
    n = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
    return n % 2 == 1


def clipped_area(ring, x0, y0, size):
    """Sutherland-Hodgman against the four sides, then the shoelace formula; signed."""
    for axis, bound, keep in ((0, x0, 1), (0, x0 + size, -1), (1, y0, 1), (1, y0 + size, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            a, b = (p[axis] - bound) * keep >= 0, (q[axis] - bound) * keep >= 0
            if a:
                out.append(p)
            if a != b:
                s = (bound - p[axis]) / (q[axis] - p[axis])
                out.append([p[k] + s * (q[k] - p[k]) if k != axis else bound for k in (0, 1)])
        ring = out
        if not ring:
            return 0.0
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(12)
    fixed = [[[[0, 0], [8, 0], [8, 4], [0, 4]]], [[[0, 0], [0, 8], [8, 8], [8, 0]], [[2, 2], [6, 2], [6, 6], [2, 6]]], [[[3, 3], [9, 3], [6, 9]]]]  # along tile edges
    return [*fixed, *(random_polygon(rng) for _ in range(25))]


def table(spark, shapes):
    rows = [(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)] + [(100, None), (101, []), (102, [[(0.0, 0.0), (1.0, 1.0)]])]
    return spark.createDataFrame(rows, "id long, rings array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize(("size", "hot"), [(4.0, 200_000), (1.3, 5), (100.0, 40)])
def test_points_in_polygons(spark, shapes, size, hot):
    rng = np.random.default_rng(3)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-30, 30, (400, 2)))] + [(400 + i, 4.0 + i / 97, 3.0) for i in range(60)] + [(500, None, 1.0), (501, 0.0, 0.0), (502, 8.0, 8.0)]
    df = spark.createDataFrame(points, "p long, x double, y double").withColumns({"edges": F.lit("clash"), "tx": F.lit("clash")})
    got = {(r["p"], r["polygon"]) for r in polygons.points_in_polygons(df, "x", "y", table(spark, shapes), "id", "rings", size, hot).collect()}
    assert got == {(p, i) for p, x, y in points if x is not None for i, rings in enumerate(shapes) if even_odd(rings, x, y)}
    assert any(p == 501 for p, _ in got) and not any(p == 502 and i in (0, 1) for p, i in got)  # left and lower edges only


@pytest.mark.parametrize(("step", "tile"), [(1.0, 32), (0.7, 3)])
def test_cells_of_polygons(spark, shapes, step, tile):
    got = {(r["polygon"], r["col"], r["row"]) for r in polygons.cells_of_polygons(table(spark, shapes), "id", "rings", step, tile).collect()}
    reach = range(int(-40 / step), int(40 / step))
    assert got == {(i, c, r) for i, rings in enumerate(shapes) for c in reach for r in reach if even_odd(rings, (c + 0.5) * step, (r + 0.5) * step)}


@pytest.mark.parametrize("size", [3.0, 0.9])
def test_block_areas_equal_clipping(spark, shapes, size):
    got = {(r["polygon"], r["bx"], r["by"]): r["area"] for r in polygons.block_areas(table(spark, shapes), "id", "rings", size).collect()}
    want = {}
    for i, rings in enumerate(shapes):
        for bx, by in itertools.product(range(int(-40 / size), int(40 / size)), repeat=2):
            parts = [abs(clipped_area(r, bx * size, by * size, size)) for r in rings]
            if (area := parts[0] - sum(parts[1:])) > 1e-9:
                want[i, bx, by] = area
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


# --- hulls ---------------------------------------------------------------------------------------------------------


def touching(a, b):
    """Whether two hulls meet, from all pairs of points: no line through two points, and none across, parts them."""
    every = [*a, *b]
    for p, q in itertools.permutations(every, 2):
        d = (q[0] - p[0], q[1] - p[1])
        for ax, ay in (d, (-d[1], d[0])):
            if max(ax * x + ay * y for x, y in a) < min(ax * x + ay * y for x, y in b) and (ax, ay) != (0, 0):
                return False
    return True


def test_known_hulls(spark):
    square, inner = [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)], [(1, 1), (2, 1), (1, 2)]
    cases = {
        "nested": (square, inner, True), "corner": (square, [(4, 4), (6, 6), (5, 7)], True), "edge": (square, [(4, 1), (6, 1)], True), "apart": (square, [(4.001, 1), (6, 1)], False),
        "points": ([(1, 1)], [(1, 1), (1, 1)], True), "two points": ([(1, 1)], [(1, 2)], False), "on a segment": ([(0, 0), (2, 2)], [(1, 1)], True), "beyond it": ([(0, 0), (2, 2)], [(3, 3)], False),
        "one line": ([(0, 0), (1, 1)], [(2, 2), (3, 3)], False), "crossing": ([(0, 0), (2, 2)], [(0, 2), (2, 0)], True), "one arm": (square, [], False), "line": ([(0, 0), (1, 1), (2, 2)], [(0, 1)], False),
    }
    rows = [(k, i == 0, float(x), float(y)) for k, (a, b, _) in cases.items() for i, side in enumerate((a, b)) for x, y in side] + [("one arm", False, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, arm boolean, x double, y double").repartition(5)
    got = {r["k"]: r["meets"] for r in hulls.overlaps(df, ["k"], "arm", "x", "y").collect()}
    assert got == {k: v[2] for k, v in cases.items()}
    assert hulls.overlaps(df.limit(0), ["k"], "arm", "x", "y").collect() == []


def test_hulls_of_a_hot_group_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 9 else f"k{i % 7}", i % 4 == 0, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (900, 2)))]
    rows = [(k, arm, a + (25 if arm and k != "hot" else 0), b) for k, arm, a, b in rows] + [(None, True, 1, 1), (None, False, 1, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        df = spark.createDataFrame(rows, "k string, arm boolean, x long, y long").repartition(6)
        got = {r["k"]: (r["meets"], r["corners_a"]) for r in hulls.overlaps(df, ["k"], "arm", "x", "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in {r[0] for r in rows}:
        a, b = ([(x, y) for k, arm, x, y in rows if k == key and arm == side] for side in (True, False))
        assert got[key] == (touching(hulls.hull(a), hulls.hull(b)), len(hulls.hull(a)))


# --- neighbours ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("leaf", "most"), [(50_000, 50_000), (20, 7)])
def test_nearest_in_six_dimensions(spark, leaf, most):
    rng = np.random.default_rng(8)
    spot = rng.random(6)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.random((300, 6)) * [1, 1, 5, 1, 1, 0])] + [(300 + i, *map(float, spot)) for i in range(200)] + [(600, *[50.0] * 6), (601, *[None] * 6), (602, *[float("nan")] * 6)]
    asked = [(i, *map(float, p)) for i, p in enumerate(rng.random((80, 6)) * 3)] + [(80 + i, *map(float, spot)) for i in range(60)] + [(200, *[900.0] * 6), (201, None, *[1.0] * 5)]
    names = [f"f{k}" for k in range(6)]
    kinds = ", ".join(f"{n} double" for n in names)
    a, b = spark.createDataFrame(asked, f"q long, {kinds}"), spark.createDataFrame(points, f"p long, {kinds}")
    got = kdtree.nearest(a.repartition(3), b.repartition(3), "q", "p", names, leaf, most).collect()
    assert len(got) == len(asked)
    good = [(p[0], np.array(p[1:])) for p in points[:501]]
    for r in got:
        x = next(q for q in asked if q[0] == r["q"])
        if None in x:
            assert r["nearest_id"] is None
            continue
        d = [(float(np.sqrt(((p - np.array(x[1:])) ** 2).sum())), i) for i, p in good]
        assert r["distance"] == pytest.approx(min(d)[0]) and r["nearest_id"] == min(i for v, i in d if v <= min(d)[0] + 1e-12)
    assert kdtree.nearest(a, b.limit(0), "q", "p", names).where("nearest_id is null").count() == len(asked)
    assert kdtree.nearest(a.limit(0), b, "q", "p", names).count() == 0


def test_a_leaf_is_searched_without_a_step_for_each_query(monkeypatch):
    """queries parted at every node, until each step of the search was made for a few of them only."""
    rng = np.random.default_rng(9)
    points, queries, rank = rng.normal(size=(5000, 6)), rng.normal(size=(400, 6)), rng.permutation(5000)
    calls, meet = [], kdtree.Tree._meet
    monkeypatch.setattr(kdtree.Tree, "_meet", lambda *a: calls.append(1) or meet(*a))
    d2, place = kdtree.Tree(points, rank).nearest(queries, np.full(400, np.inf))
    each = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (place == each.argmin(axis=1)).all() and np.allclose(d2, each.min(axis=1))
    assert len(calls) < 400, len(calls)


def test_of_equally_near_points_the_smallest_rank_counts():
    rng = np.random.default_rng(10)
    points = np.stack(np.meshgrid(*[np.arange(3.0)] * 6), -1).reshape(-1, 6)
    queries, rank = rng.integers(0, 5, (200, 6)) / 2, rng.permutation(len(points))
    tree = kdtree.Tree(points, rank)
    d2, place = tree.nearest(queries, np.full(200, np.inf))
    each = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (d2 == each.min(axis=1)).all()
    assert (rank[place] == np.where(each == d2[:, None], rank, len(rank)).min(axis=1)).all()
    assert (tree.nearest(queries, d2)[1] == place).all()  # a bound is met exactly
    assert (tree.nearest(queries, d2 - 0.01)[1] == -1).all()


def test_standardised_features(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2), (3.0, 5.0, 4), (None, 5.0, 6)], "a double, b double, c long")
    got = kdtree.standardised(df, df, ["a", "b"]).orderBy("c").collect()
    assert [r["a"] for r in got] == [-1.0, 1.0, None] and [r["b"] for r in got] == [0.0, 0.0, 0.0]
