"""Spatial joins against brute force, in both physical ways, with skew and hard cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from geosieve import BoxColumns, Layer, PointColumns, ShapeColumn
from geosieve.functions import geometry as geo
from geosieve.operators import chains, spatial
from geosieve.operators.geometry_jobs import ingest_wkt

WAYS = ("broadcast", "shuffle")


def points(spark, rows, crs="EPSG:3857"):
    return Layer(spark.createDataFrame(rows, "id long, x double, y double"), ("id",), PointColumns(), crs)


def boxes(spark, rows):
    return Layer(spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double"), ("id",),
                 BoxColumns())


def shapes(spark, rows):
    df = spark.createDataFrame(rows, "id long, wkt string")
    return Layer(df.withColumn("geom", geo.from_wkt(F.col("wkt"))), ("id",), ShapeColumn())


def ids(df):
    found = [r["id"] for r in df.select("id").collect()]
    assert len(found) == len(set(found)), "a target came out twice"
    return set(found)


def pair_set(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found)), "a pair came out twice"
    return set(found)


def random_boxes(n, seed, sizes=(0.1, 1, 7, 60, 900)):
    """Sizes over many levels, on a half-unit raster so that borders do meet."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side = rng.choice(sizes)
        w, h = (max(0.5, round(rng.uniform(0.2, 1) * side * 2) / 2) for _ in range(2))
        x, y = (round(rng.uniform(-200, 800) * 2) / 2 for _ in range(2))
        rows.append((i, x, y, x + w, y + h))
    return rows


def meets(a, b, d=0.0):
    dx, dy = max(b[1] - a[3], a[1] - b[3], 0), max(b[2] - a[4], a[2] - b[4], 0)
    return dx * dx + dy * dy <= d * d


def with_way(target, source, way, radius=None):
    plan = spatial.plan_join(target, source, radius, way)
    assert plan.strategy == way
    return plan


@pytest.mark.parametrize("way", WAYS)
def test_boxes_of_all_sizes(spark, way):
    t, s = random_boxes(300, 1), random_boxes(300, 2)
    target, source = boxes(spark, t), boxes(spark, s)
    plan = with_way(target, source, way)
    assert len(plan.levels) > 1
    expected = {(a[0], b[0]) for a, b in itertools.product(t, s) if meets(a, b)}
    assert pair_set(spatial.spatial_pairs(target, source, plan=plan)) == expected
    assert ids(spatial.spatial_filter(target, source, plan=plan)) == {a for a, _ in expected}


def test_whole_rows_are_exchanged_once(spark):
    """A shuffled join on several levels sends keys and geometries; the other columns meet the found keys at the end."""
    rows = [(i, float(i), 0.0, i + 4.0 ** (i % 6), 1.0) for i in range(60)]
    layer = boxes(spark, rows)
    wide = layer.with_df(layer.df.withColumn("payload", F.lit("x")))
    plan = spatial.plan_join(wide, layer, strategy="shuffle")
    assert len(plan.levels) > 1
    for names, mode in ((("intersects",), "any"), (("disjoint",), "all")):
        found = spatial.spatial_filter(wide, layer.where("id % 7 = 0"), names, mode=mode, plan=plan)
        text = found._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = [part for part in text.split("\n\n") if "Exchange" in part.split("\n")[0] and "payload" in part]
        assert len(sent) <= 1, sent
    met = {x.id for x in spatial.spatial_filter(wide, layer.where("id % 7 = 0"), plan=plan).collect()}
    want = {i for i, a, _, b, _ in rows if any(j % 7 == 0 and a <= d and c_ <= b for j, c_, _, d, _ in rows)}
    assert met == want


@pytest.mark.parametrize("way", WAYS)
def test_radius_over_boxes(spark, way):
    t, s = random_boxes(200, 3), random_boxes(200, 4, (0.1, 1, 7))
    target, source = boxes(spark, t), boxes(spark, s)
    plan = with_way(target, source, way, 4.5)
    expected = {(a[0], b[0]) for a, b in itertools.product(t, s) if meets(a, b, 4.5)}
    assert pair_set(spatial.spatial_pairs(target, source, radius=4.5, plan=plan)) == expected


@pytest.mark.parametrize("way", WAYS)
def test_row_radius_of_all_sizes(spark, way):
    rng = random.Random(5)
    t = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(500)]
    s = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000), rng.choice([0.0, 0.5, 3.0, 40.0, 500.0])) for i in range(60)]
    target = points(spark, t)
    source = Layer(spark.createDataFrame(s, "id long, x double, y double, r double"), ("id",), PointColumns())
    plan = with_way(target, source, way, "r")
    expected = {a[0] for a in t if any((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= b[3] ** 2 for b in s)}
    assert ids(spatial.spatial_filter(target, source, radius="r", plan=plan)) == expected
    assert ids(spatial.spatial_filter(target, source, "disjoint", radius="r", mode="all", plan=plan)) == {
        a[0] for a in t} - expected


def test_third_of_all_rows_in_one_place(spark):
    """Hot cell and copies on both sides: salted by force, and still exact."""
    rng = random.Random(6)
    t = [(i, 5.0, 5.0) if i % 3 == 0 else (i, rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(900)]
    s = [(i, 4.0, 4.0, 6.0, 6.0) if i % 3 == 0 else (i, (x := rng.uniform(0, 400)), (y := rng.uniform(0, 400)), x + 2, y + 2)
         for i in range(300)]
    target, source = points(spark, t), boxes(spark, s)
    plan = spatial.plan_join(target, source, strategy="shuffle", one_in=1, floor=20)
    assert plan.hot and max(h[3] for h in plan.hot) > 8
    expected = {(a[0], b[0]) for a in t for b in s if b[1] <= a[1] <= b[3] and b[2] <= a[2] <= b[4]}
    assert ids(spatial.spatial_filter(target, source, plan=plan)) == {a for a, _ in expected}
    assert pair_set(spatial.spatial_pairs(target, source, plan=plan)) == expected


def test_third_of_all_boxes_in_one_place(spark):
    rng = random.Random(10)
    t = [(i, 100.0, 100.0, 103.0, 104.0) if i % 3 == 0 else r for i, r in enumerate(random_boxes(240, 11))]
    s = [(i, 101.0, 101.0, 109.0, 108.0) if i % 3 == 0 else r for i, r in enumerate(random_boxes(200, 12))]
    rng.shuffle(t)
    target, source = boxes(spark, t), boxes(spark, s)
    plan = spatial.plan_join(target, source, strategy="shuffle", one_in=1, floor=20)
    assert plan.hot and len(plan.levels) > 1
    expected = {(a[0], b[0]) for a in t for b in s if meets(a, b)}
    assert pair_set(spatial.spatial_pairs(target, source, plan=plan)) == expected
    assert ids(spatial.spatial_filter(target, source, plan=plan)) == {a for a, _ in expected}


def test_shuffled_joins_are_merge_joins(spark):
    """The measured choice holds even where the optimizer believes the source to be small."""
    target, source = boxes(spark, random_boxes(50, 13)), boxes(spark, random_boxes(50, 14))
    plan = with_way(target, source, "shuffle")
    for df in (spatial.spatial_pairs(target, source, plan=plan), spatial.spatial_filter(target, source, plan=plan)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and "NestedLoop" not in text
    text = spatial.spatial_filter(target, source)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_edges_corners_holes_and_missing_points(spark):
    zone = shapes(spark, [(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))")])
    rows = [(1, 0.0, 5.0), (2, 10.0, 10.0), (3, 4.0, 5.0), (4, 5.0, 5.0), (5, 0.5, 0.5), (6, -0.001, 5.0),
            (7, None, 5.0), (8, float("nan"), 5.0), (9, 6.0, 6.0), (10, float("inf"), 1.0)]
    target = points(spark, rows)
    find = lambda p, **k: ids(spatial.spatial_filter(target, zone, p, **k))
    assert find("intersects") == {1, 2, 3, 5, 9}
    assert find("within") == {5}
    assert find("touches") == {1, 2, 3, 9}
    assert find("coveredby") == {1, 2, 3, 5, 9}
    assert find(("contains", "covers", "crosses", "overlaps", "equals")) == set()
    assert find("disjoint", mode="all") == {4, 6}
    assert find(("within", "touches")) == {1, 2, 3, 5, 9}
    assert find(()) == set()


def test_points_on_lines(spark):
    line = shapes(spark, [(1, "LINESTRING (0 0, 10 0, 10 10)"), (2, "MULTILINESTRING ((20 0, 30 0), (30 0, 30 5))")])
    target = points(spark, [(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 10.0, 0.0), (4, 10.0, 10.0), (5, 5.0, 0.1), (6, 30.0, 0.0),
                            (7, 20.0, 0.0)])
    assert ids(spatial.spatial_filter(target, line)) == {1, 2, 3, 4, 6, 7}
    assert ids(spatial.spatial_filter(target, line, "within")) == {2, 3, 6}  # an end shared by two parts is inner
    assert ids(spatial.spatial_filter(target, line, "touches")) == {1, 4, 7}
    assert ids(spatial.spatial_filter(target, line, radius=0.1)) == {1, 2, 3, 4, 5, 6, 7}


def star(cx, cy, r, n, rng):
    corners = [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n),
                cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return corners + corners[:1]


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def gap(x, y, ring):
    best = math.inf
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        dx, dy = x2 - x1, y2 - y1
        t = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


@pytest.mark.parametrize("way", WAYS)
def test_ragged_polygons(spark, way):
    rng = random.Random(7)
    rings = [star(rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([3, 20, 90]), rng.randint(5, 40), rng)
             for _ in range(25)]
    wkt = [(i, "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in r) + "))") for i, r in enumerate(rings)]
    t = [(i, rng.uniform(-20, 320), rng.uniform(-20, 320)) for i in range(600)]
    target, source = points(spark, t), shapes(spark, wkt)
    for radius, test in ((None, lambda a, r: inside(a[1], a[2], r)),
                         (6.0, lambda a, r: inside(a[1], a[2], r) or gap(a[1], a[2], r) <= 6),
                         (-2.0, lambda a, r: inside(a[1], a[2], r) and gap(a[1], a[2], r) >= 2)):
        plan = with_way(target, source, way, radius)
        expected = {a[0] for a in t if any(test(a, r) for r in rings)}
        assert ids(spatial.spatial_filter(target, source, radius=radius, plan=plan)) == expected


def test_disjoint_any_and_all(spark):
    t = random_boxes(120, 8, (7, 60))
    s = [(1, 0.0, 0.0, 400.0, 400.0), (2, 100.0, 100.0, 500.0, 500.0), (3, 50.0, 120.0, 420.0, 300.0)]
    target, source = boxes(spark, t), boxes(spark, s)
    assert ids(spatial.spatial_filter(target, source, "disjoint")) == {
        a[0] for a in t if any(not meets(a, b) for b in s)}
    assert ids(spatial.spatial_filter(target, source, "disjoint", mode="all")) == {
        a[0] for a in t if all(not meets(a, b) for b in s)}


def test_empty_source(spark):
    target, none = points(spark, [(1, 0.0, 0.0)]), boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)]).where("id < 0")
    assert ids(spatial.spatial_filter(target, none)) == set()
    assert ids(spatial.spatial_filter(target, none, "disjoint", mode="all")) == {1}
    assert ids(spatial.spatial_filter(target, none, "disjoint")) == set()
    assert pair_set(spatial.spatial_pairs(target, none)) == set()


def test_within_radius_touches_and_wrong_uses(spark):
    target = points(spark, [(1, 3.0, 4.0), (2, 3.0, 3.9), (3, 9.0, 9.0)])
    centre = points(spark, [(1, 0.0, 0.0)])
    assert ids(spatial.spatial_filter(target, centre, "touches", radius=5)) == {1}
    assert ids(spatial.spatial_filter(target, centre, "within", radius=5)) == {2}
    assert ids(spatial.spatial_filter(target, centre, radius=F.lit(None))) == set()
    with pytest.raises(ValueError):
        spatial.spatial_filter(target, centre, "near")
    with pytest.raises(ValueError):
        spatial.spatial_filter(boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)]), centre, "overlaps", radius=5).count()
    with pytest.raises(ValueError):
        spatial.spatial_pairs(target, centre, "disjoint")


@pytest.mark.parametrize("way", ["broadcast", "shuffle"])
def test_boxes_against_grown_and_shrunk_boxes(spark, way):
    """All predicates of a radius between boxes, by plain formulas; whole coordinates, so that borders meet."""
    r = random.Random(4)
    rows = [[(i, *sum(([a, b] for a, b in [(float(r.randrange(40)), float(r.randrange(40)))]), []),
              float(r.choice([0, 1, 4, 12])), float(r.choice([0, 2, 5, 9]))) for i in range(120)] for _ in range(2)]
    sides = [[(i, x, y, x + w, y + h) for i, x, y, w, h in side] for side in rows]
    target, source = (boxes(spark, side) for side in sides)
    for radius in (3, -2):
        plan = spatial.plan_join(target, source, radius, strategy=way)
        for name in ("intersects", "within", "coveredby", "covers", "contains", "touches"):
            got = {tuple(x) for x in spatial.spatial_pairs(target, source, name, radius=radius, plan=plan).collect()}
            want = set()
            for i, a0, b0, a1, b1 in sides[0]:
                for j, c0, d0, c1, d1 in sides[1]:
                    if radius > 0:
                        gap = max(c0 - a1, a0 - c1, 0) ** 2 + max(d0 - b1, b0 - d1, 0) ** 2
                        far = max(c0 - a0, a1 - c1, 0) ** 2 + max(d0 - b0, b1 - d1, 0) ** 2
                        over = a0 <= c0 - radius and b0 <= d0 - radius and a1 >= c1 + radius and b1 >= d1 + radius
                        ok = {"intersects": gap <= 9, "touches": gap == 9, "coveredby": far <= 9, "within": far <= 9 and gap < 9,
                              "covers": over, "contains": over}[name]
                    else:
                        c0, d0, c1, d1 = c0 + 2, d0 + 2, c1 - 2, d1 - 2
                        meet = a0 <= c1 and a1 >= c0 and b0 <= d1 and b1 >= d0
                        inner = all((lo < a < hi) if a == b else (a < hi and b > lo)
                                    for a, b, lo, hi in ((a0, a1, c0, c1), (b0, b1, d0, d1)))
                        held, over = (a0 >= c0 and a1 <= c1 and b0 >= d0 and b1 <= d1,
                                      a0 <= c0 and a1 >= c1 and b0 <= d0 and b1 >= d1)
                        ok = c1 > c0 and d1 > d0 and {
                            "intersects": meet, "touches": meet and not inner, "coveredby": held, "within": held and inner,
                            "covers": over, "contains": over and inner}[name]
                    if ok:
                        want.add((i, j))
            assert got == want, (name, radius)
    apart = {x.id for x in spatial.spatial_filter(target, source, "disjoint", radius=-2, mode="all").collect()}
    near = {x.id for x in spatial.spatial_filter(target, source, radius=-2).collect()}
    assert apart == set(range(120)) - near and near


def test_chain_modes_differ(spark):
    zone, far = boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0)]), points(spark, [(1, 9.0, 5.0), (2, 30.0, 5.0)])
    target = points(spark, [(1, 8.0, 5.0), (2, 11.0, 5.0), (3, 29.0, 5.0)])
    steps = [chains.SpatialStep(zone), chains.SpatialStep(far, radius=3)]
    assert ids(chains.chain(target, steps, "target")) == {1}
    assert ids(chains.chain(target, steps, "source")) == {1, 2}
    assert ids(chains.chain(target, steps, "source", custom="id = 2")) == set()


def test_metric_radius_and_centroids(spark):
    target = points(spark, [(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.01, 0.0)], "EPSG:4326")
    near = spatial.spatial_filter(target, target.where("id = 1"), radius=200, metric=True)
    assert ids(near) == {1, 2} and near.columns == ["id", "x", "y"]
    ell = shapes(spark, [(1, "POLYGON ((0 0, 10 0, 10 1, 1 1, 1 10, 0 10, 0 0))")])
    around = boxes(spark, [(1, 2.0, 2.0, 9.0, 9.0)])
    assert ids(spatial.spatial_filter(ell, around, use_centroids="target", point_mode="centroid")) == {1}
    assert ids(spatial.spatial_filter(ell, around, use_centroids="target")) == set()


# expected: predicates that hold for (target, source)
PAIRS = [
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((4 4, 0 4, 0 0, 4 0, 4 4))",
     {"intersects", "contains", "within", "equals", "covers", "coveredby"}),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", {"intersects", "touches"}),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((4 4, 8 4, 8 8, 4 8, 4 4))", {"intersects", "touches"}),
    ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))", "POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))", {"intersects", "contains", "covers"}),
    ("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))", {"intersects", "within", "coveredby"}),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", {"intersects", "overlaps"}),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((4.5 4.5, 6 4.5, 6 6, 4.5 6, 4.5 4.5))", set()),
    ("POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))",
     "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))", set()),
    ("POLYGON ((3 3, 7 3, 7 7, 3 7, 3 3))",
     "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))", {"intersects", "touches"}),
    ("LINESTRING (-1 2, 5 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", {"intersects", "crosses"}),
    ("LINESTRING (1 1, 3 3)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", {"intersects", "within", "coveredby"}),
    ("LINESTRING (0 0, 4 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", {"intersects", "touches", "coveredby"}),
    ("LINESTRING (-2 2, 0 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", {"intersects", "touches"}),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "LINESTRING (1 1, 3 3)", {"intersects", "contains", "covers"}),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (0 4, 4 0)", {"intersects", "crosses"}),
    ("LINESTRING (0 0, 4 0)", "LINESTRING (2 0, 6 0)", {"intersects", "overlaps"}),
    ("LINESTRING (0 0, 4 0)", "LINESTRING (4 0, 4 4)", {"intersects", "touches"}),
    ("LINESTRING (0 0, 4 0)", "LINESTRING (4 0, 2 0, 0 0)",
     {"intersects", "contains", "within", "equals", "covers", "coveredby"}),
    ("LINESTRING (0 0, 4 0)", "LINESTRING (1 0, 2 0)", {"intersects", "contains", "covers"}),
]
NAMES = ("intersects", "contains", "within", "touches", "overlaps", "crosses", "equals", "covers", "coveredby")


@pytest.mark.parametrize("name", NAMES)
def test_shape_relations(spark, name):
    target = shapes(spark, [(i, a) for i, (a, _, _) in enumerate(PAIRS)])
    source = shapes(spark, [(i, b) for i, (_, b, _) in enumerate(PAIRS)])
    found = pair_set(spatial.spatial_pairs(target, source, name))
    assert {i for i, j in found if i == j} == {i for i, (_, _, holds) in enumerate(PAIRS) if name in holds}


def test_shapes_meet_agrees_with_the_relation(spark):
    rng = random.Random(9)
    rows = [(i, "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in star(
        rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([2, 9, 25]), rng.randint(4, 12), rng)) + "))")
        for i in range(40)]
    layer = shapes(spark, rows)
    meet = pair_set(spatial.spatial_pairs(layer, layer))
    by_relation = pair_set(spatial.spatial_pairs(layer, layer, ("touches", "overlaps", "covers", "coveredby")))
    assert meet == by_relation
    apart = pair_set(spatial.spatial_pairs(layer, layer, radius=5.0))
    near = layer.df.select(F.col("id").alias("a"), F.col("geom").alias("g")).join(
        layer.df.select(F.col("id").alias("b"), F.col("geom").alias("h")), F.lit(True)).where(geo.distance("g", "h") <= 5)
    assert apart == {(r["a"], r["b"]) for r in near.select("a", "b").collect()}


def test_ingest_keeps_bad_rows_apart(spark):
    texts = ["POINT (1 2)", "point z (1 2 3)", "POINT EMPTY", "", "PIONT (1 2)", "POLYGON ((0 0, 1 0, 1 1, 0 0)",
             "POLYGON ((0 0, 1 0, x 1, 0 0))", "MULTIPOINT ((1 2), (3 4))", "MULTIPOINT (1 2, 3 4)",
             "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 5.5, 7 5.5, 7 6, 6 5.5)))",
             "LINESTRING (0 0, 1 1)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "POINT (1 2, 3 4)", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, wkt string")
    good, bad = ingest_wkt(df, "wkt")
    assert {r["id"] for r in bad.collect()} == {3, 4, 5, 6, 12}
    out = {r["id"]: (r["w"], r["issue"]) for r in good.select(
        "id", geo.to_wkt(F.col("geom")).alias("w"), geo.geometry_issue(F.col("geom")).alias("issue")).collect()}
    assert out[0] == ("POINT (1 2)", None) and out[1] == ("POINT (1 2)", None)
    assert out[2] == ("POINT EMPTY", "empty") and out[13] == (None, "null")
    assert out[7] == out[8] == ("MULTIPOINT (1 2, 3 4)", None)
    assert out[9][0] == ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), "
                         "(6 5.5, 7 5.5, 7 6, 6 5.5)))")
    assert out[10][0] == "LINESTRING (0 0, 1 1)" and out[11][0] == "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"


def test_chain_steps_are_measured_on_the_base(spark):
    """Jobs before any action grow with the number of steps, not with its square, and read no earlier step."""
    target = boxes(spark, random_boxes(300, 5))
    sources = [boxes(spark, random_boxes(20, 50 + i)) for i in range(4)]
    jobs = []
    for n in (1, 2, 4):
        spark.sparkContext.setJobGroup(f"chain{n}", "chain")
        df = chains.chain(target, [chains.SpatialStep(s) for s in sources[:n]])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}")))
        expected = {t[0] for t in random_boxes(300, 5)
                    if all(any(meets(t, s) for s in random_boxes(20, 50 + i)) for i in range(n))}
        assert ids(df) == expected
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == 2 * jobs[0] and jobs[2] == 4 * jobs[0]
