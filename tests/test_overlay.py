"""Unions of polygons against exact slabs, flood filled cells and hand-made cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geosieve.functions.geometry import from_wkt
from geosieve.layer import BoxColumns, Layer
from geosieve.operators import overlay as ov


def layer_of(spark, rows):
    """Rows of (group, WKT)."""
    df = spark.createDataFrame([(i, g, w) for i, (g, w) in enumerate(rows)], "id long, grp string, wkt string")
    return Layer(df.withColumn("geom", from_wkt(F.col("wkt"))), ("id",))


def wkt(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def measures(layer, **options):
    rows = ov.dissolve_measures(ov.dissolve(layer, ["grp"], **options), ["grp"]).collect()
    return {r.grp: tuple(r)[1:] for r in rows}


def square(x, y, n=10):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]


CASES = {
    "one": ([wkt(square(0, 0))], (100, 40, 1, 0, 4)),
    "clockwise": ([wkt(square(0, 0)[::-1])], (100, 40, 1, 0, 4)),
    "copies": ([wkt(square(0, 0))] * 3, (100, 40, 1, 0, 4)),
    "overlap": ([wkt(square(0, 0)), wkt(square(5, 5))], (175, 60, 1, 0, 8)),
    "side by side": ([wkt(square(0, 0)), wkt(square(10, 0))], (200, 60, 1, 0, 4)),
    "half a side": ([wkt(square(0, 0)), wkt(square(10, 5))], (200, 70, 1, 0, 8)),
    "at a corner": ([wkt(square(0, 0)), wkt(square(10, 10))], (200, 80, 2, 0, 8)),
    "apart": ([wkt(square(0, 0)), wkt(square(30, 0))], (200, 80, 2, 0, 8)),
    "inside": ([wkt(square(0, 0)), wkt(square(3, 3, 2))], (100, 40, 1, 0, 4)),
    "hole": ([wkt(square(0, 0), square(3, 3, 2))], (96, 48, 1, 1, 8)),
    "hole filled": ([wkt(square(0, 0), square(3, 3, 2)), wkt(square(3, 3, 2))], (100, 40, 1, 0, 4)),
    "island in a hole": ([wkt(square(0, 0), square(2, 2, 6)), wkt(square(4, 4, 1))], (65, 68, 2, 1, 12)),
    "frame": ([wkt([(0, 0), (10, 0), (10, 2), (0, 2)]), wkt([(0, 8), (10, 8), (10, 10), (0, 10)]),
               wkt([(0, 0), (2, 0), (2, 10), (0, 10)]), wkt([(8, 0), (10, 0), (10, 10), (8, 10)])], (64, 64, 1, 1, 8)),
}
# the lower arm reaches over the border of the hole: the square loses nothing, and gains 4 x 5 / 2 below
CASES["hole cut"] = ([wkt(square(0, 0), square(2, 2, 6)), wkt([(4, -5), (6, -5), (6, 5), (4, 5)])],
                     (64 + 10 + 6, 40 + 10 + 24 + 6, 1, 1, 16))
# the diamond holds the square
CASES["diamond on a square"] = ([wkt(square(0, 0)), wkt([(5, -5), (15, 5), (5, 15), (-5, 5)])],
                                (200, 40 * math.sqrt(2), 1, 0, 4))


def union_area(polygons):
    """Exact area of a union of polygons, by slabs between all corners and crossings."""
    edges = [(a, b) for p in polygons for a, b in zip(p, p[1:] + p[:1])]
    xs = {x for p in polygons for x, _ in p}
    for i, ((ax, ay), (bx, by)) in enumerate(edges):
        for (cx, cy), (dx, dy) in edges[:i]:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
                xs.add(ax + t * (bx - ax))
    xs, total = sorted(xs), 0.0
    for low, high in zip(xs, xs[1:]):
        mid, spans = (low + high) / 2, []
        for p in polygons:
            ys = sorted(a[1] + (mid - a[0]) * (b[1] - a[1]) / (b[0] - a[0])
                        for a, b in zip(p, p[1:] + p[:1]) if (a[0] <= mid) != (b[0] <= mid))
            spans += list(zip(ys[::2], ys[1::2]))
        end = -math.inf
        for a, b in sorted(spans):
            total += max(0.0, b - max(a, end)) * (high - low)
            end = max(end, b)
    return total


def random_polygons():
    r, groups = random.Random(7), {}
    for name, n in {"few": 3, "some": 12, "many": 40}.items():
        groups[name] = []
        for _ in range(n):
            x, y, size = r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(2, 25)
            angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(r.randrange(3, 8)))
            groups[name].append([(round(x + size * math.cos(a), 3), round(y + size * math.sin(a), 3)) for a in angles])
    return groups


def flood(cells):
    """Shells (cells that share sides) and holes (gaps that share sides or corners, without the outside)."""
    def count(left, steps):
        n = 0
        left = set(left)
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                x, y = todo.pop()
                for a, b in steps:
                    if (x + a, y + b) in left:
                        left.remove((x + a, y + b))
                        todo.append((x + a, y + b))
        return n

    side = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    gaps = {(x, y) for x in range(-1, 41) for y in range(-1, 41)} - cells
    return count(cells, side), count(gaps, [*side, (1, 1), (1, -1), (-1, 1), (-1, -1)]) - 1


def random_boxes():
    """Boxes on whole coordinates by group, and what their cells say: area, perimeter, shells, holes."""
    r, rows, want = random.Random(11), [], {}
    for name in ("a", "b", None):
        cells = set()
        for _ in range(45):
            x, y, w, h = r.randrange(36), r.randrange(36), r.randrange(1, 6), r.randrange(1, 5)
            rows.append((name, wkt([(x, y), (min(40, x + w), y), (min(40, x + w), min(40, y + h)), (x, min(40, y + h))])))
            cells |= {(i, j) for i in range(x, min(40, x + w)) for j in range(y, min(40, y + h))}
        sides = sum((x + a, y + b) not in cells for x, y in cells for a, b in [(1, 0), (-1, 0), (0, 1), (0, -1)])
        want[name] = (len(cells), sides, *flood(cells))
    return rows, want


@pytest.mark.parametrize("cell", [None, 1 << 14])
def test_unions(spark, cell):
    """All groups at once: hand-made cases, polygons with rounded crossings, boxes that touch in every way."""
    polygons, (boxes, want) = random_polygons(), random_boxes()
    rows = [(name, w) for name, (shapes, _) in CASES.items() for w in shapes] + boxes
    rows += [(g, wkt(p)) for g, ps in polygons.items() for p in ps]
    rows += [("nothing", None), ("empty", "POLYGON EMPTY"), ("line", "LINESTRING (0 0, 1 1)")]
    got = measures(layer_of(spark, rows), cell=cell)
    assert got.keys() == {*CASES, *polygons, *want}
    for name, (_, expected) in CASES.items():
        assert got[name] == pytest.approx(expected, rel=1e-9), name
    for name, expected in want.items():
        assert got[name][:4] == pytest.approx(expected, rel=1e-9), name
    for name, ps in polygons.items():
        # crossings are rounded to 0.001
        assert got[name][0] == pytest.approx(union_area(ps), abs=0.05), name


def test_rings_are_in_order(spark):
    rows = ov.dissolve(layer_of(spark, [("g", wkt(square(0, 0), square(2, 2, 6))), ("g", wkt(square(5, 5)))]), ["grp"]).collect()
    for ring in {r.ring for r in rows}:
        own = sorted((r.place, r.x, r.y, r.hole) for r in rows if r.ring == ring)
        turn = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(own, own[1:] + own[:1]))
        assert (turn < 0) == own[0][3]
        assert all((a[1] == b[1]) != (a[2] == b[2]) for a, b in zip(own, own[1:] + own[:1]))


def test_boxes_and_precision(spark):
    df = spark.createDataFrame([(1, "g", 0.0, 0.0, 1e7, 1e7), (2, "g", 1e7, 0.0, 1.5e7, 1e7)],
                               "id long, grp string, xmin double, ymin double, xmax double, ymax double")
    layer = Layer(df, ("id",), BoxColumns())
    with pytest.raises(Exception, match="too long"):
        ov.polygon_edges(layer, ["grp"]).collect()
    edges = {tuple(r)[1:] for r in ov.polygon_edges(layer, ["grp"], 1.0).collect()}
    assert len(edges) == 6  # the shared side has no weight left
    assert ov.polygon_edges(layer.where("id > 5"), ["grp"]).count() == 0
