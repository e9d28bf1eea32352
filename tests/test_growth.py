"""Joins whose work must grow with the tables, not with the square of their density."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.functions.crs import metre_bounds_sql, metre_gap_sql, to_mercator
from geosieve.layer import Layer, PointColumns
from geosieve.operators import spatial
from tests.test_candidates import boxes, some_boxes


def _meeting(target, source) -> set[int]:
    near = "t.xmin <= s.xmax AND t.xmax >= s.xmin AND t.ymin <= s.ymax AND t.ymax >= s.ymin"
    return {r.id for r in target.df.alias("t").join(source.df.alias("s"), F.expr(near)).select("t.id").collect()}


def test_targets_of_all_sizes_share_a_join_per_level_of_sources(spark):
    target = boxes(spark, [(i, float(i * 37 % 9000), float(i * 53 % 9000), float(i * 37 % 9000 + side), float(i * 53 % 9000 + 1))
                           for i, side in enumerate((1, 60, 900, 4000, 15000) * 40)])
    for sides in ((3,), (1, 30)):
        source = some_boxes(spark, 40, sides)
        plan = spatial.plan_join(target, source, strategy="broadcast")
        assert len(plan.levels) > len(plan.source_levels)
        found = spatial.spatial_filter(target, source, plan=plan)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == len(plan.source_levels)
        apart = spatial.spatial_filter(target, source, "disjoint", mode="all", plan=plan)
        want = _meeting(target, source)
        assert {r.id for r in found.collect()} == want and want
        assert {r.id for r in apart.collect()} == set(range(200)) - want


def _crowd(spark, n: int):
    """Boxes on few places, many within others, some flat, and points on and off their borders."""
    rows = [(i, float(i * 37 % 50), float(i * 53 % 50), float(i * 37 % 50 + i % 13), float(i * 53 % 50 + i % 11)) for i in range(n)]
    rows += [(-1, None, 0.0, 90.0, 90.0)]
    points = spark.createDataFrame(
        [(i, i * 7 % 150 / 2 - 4, i * 11 % 141 / 2 - 4) for i in range(3000)] + [(-1, None, 1.0)], "pid long, x double, y double")
    return boxes(spark, rows), Layer(points, ("pid",), PointColumns())


def test_points_meet_only_what_decides_in_crowded_cells(spark, monkeypatch):
    source, points = _crowd(spark, 2000)
    inside = "t.x BETWEEN s.xmin AND s.xmax AND t.y BETWEEN s.ymin AND s.ymax"
    within = "t.x > s.xmin AND t.x < s.xmax AND t.y > s.ymin AND t.y < s.ymax"
    near = "t.x IS NOT NULL AND pow(greatest(s.xmin - t.x, t.x - s.xmax, 0), 2) + pow(greatest(s.ymin - t.y, t.y - s.ymax, 0), 2) <= 1"
    solid = source.where("xmax > xmin AND ymax > ymin")
    shapes = solid.as_shapes()
    keys = lambda df: {r.pid for r in df.select("pid").collect()}
    for layer, names, radius, test in ((source, ("intersects",), None, inside), (shapes, ("intersects",), None, inside),
                                       (shapes, ("within",), None, within), (shapes, ("intersects",), 1, near)):
        raw = spatial.plan_join(points, layer, radius, strategy="broadcast")
        kept = sum(t.count() for t in spatial._thinned(layer, radius, raw))
        assert kept < raw.tiles / 2
        monkeypatch.setattr(spatial, "BROADCAST_ROWS", kept)
        plan = spatial.plan_join(points, layer, radius, names=names)
        assert plan.thinned and plan.strategy == "broadcast" and not spatial.plan_join(points, layer, radius).thinned
        solids = solid.df if layer is shapes else source.df
        want = keys(points.df.alias("t").join(solids.alias("s"), F.expr(test)).select("t.pid"))
        assert keys(spatial.spatial_filter(points, layer, names, radius)) == want and 0 < len(want) < 3000
        if names == ("intersects",):
            apart = keys(spatial.spatial_filter(points, layer, "disjoint", radius, mode="all"))
            assert apart == set(range(3000)) - want
    border = f"{inside} AND NOT ({within})"
    want = keys(points.df.alias("t").join(solid.df.alias("s"), F.expr(border)).select("t.pid"))
    assert keys(spatial.spatial_filter(points, shapes, "touches")) == want


def test_cells_keep_few_of_many_boxes(spark):
    counts = []
    for n in (2000, 8000):
        source, points = _crowd(spark, n)
        plan = spatial.plan_join(points, source, strategy="broadcast")
        assert plan.crowded()
        counts.append(sum(t.count() for t in spatial._thinned(source, None, plan)))
    assert counts[1] <= counts[0] * 1.2 and counts[0] < plan.tiles / 8


def test_metre_bounds_agree_with_the_formula(spark):
    rows = [(lon + i * 0.031, lat + j * 0.029, lon, lat, metres) for lon in (0.0, 179.0) for lat in (-80.0, -40.0, 0.0, 33.0, 70.0, 88.5)
            for metres in (0.5, 25000.0, 150000.0) for i in range(-20, 21, 4) for j in range(-20, 21, 4)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, m double")
    (tx, ty), (sx, sy) = to_mercator(F.col("a"), F.col("b")), to_mercator(F.col("c"), F.col("d"))
    df = df.select("m", tx.alias("tx"), ty.alias("ty"), sx.alias("sx"), sy.alias("sy"))
    surely, never = metre_bounds_sql("tx", "ty", "sx", "sy", "m")
    found = df.selectExpr(f"{surely} AS surely", f"{never} AS never", f"{metre_gap_sql('tx', 'ty', 'sx', 'sy')} < m AS near").collect()
    assert all(r.near for r in found if r.surely) and not any(r.near for r in found if r.never)
    assert sum(not r.surely and not r.never for r in found) < len(found) * 0.6 and any(r.surely for r in found)


def test_geodesic_pairs_come_once_without_an_aggregate_of_them(spark):
    rows = [(i, lon, lat) for i, (lon, lat) in enumerate([(179.99, 10.0), (-179.99, 10.0), (0.0, 89.7), (90.0, 89.7), (-180.0, 89.7),
                                                         (180.0, 89.7), (-90.0, 89.7), (45.0, 20.0), (45.1, 20.1)])]
    points = lambda rows: Layer(spark.createDataFrame(rows, "id long, x double, y double"), ("id",), PointColumns(), "EPSG:4326")
    pairs = spatial.spatial_pairs(points(rows), points(rows), radius=100000, metric="geodesic")
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {(a, b) for group in ((0, 1), (2, 3, 4, 5, 6), (7, 8)) for a in group for b in group}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)
    twice = spatial.spatial_pairs(points(rows * 2), points(rows), radius=100000, metric="geodesic")
    assert sorted(tuple(r) for r in twice.collect()) == sorted(want)


def test_boxes_within_grown_ones_seldom_need_the_farthest_corner(spark):
    target = boxes(spark, [(i, float(i * 37 % 60), float(i * 53 % 60), i * 37 % 60 + i % 7 / 2, i * 53 % 60 + i % 5 / 2) for i in range(300)])
    source = boxes(spark, [(i, float(i * 31 % 60), float(i * 47 % 60), float(i * 31 % 60 + i % 9), float(i * 47 % 60 + i % 4)) for i in range(200)])
    far, gap = ("pow(greatest({0}, {1}, 0), 2) + pow(greatest({2}, {3}, 0), 2)".format(*sides) for sides in (
        ("s.xmin - t.xmin", "t.xmax - s.xmax", "s.ymin - t.ymin", "t.ymax - s.ymax"),
        ("s.xmin - t.xmax", "t.xmin - s.xmax", "s.ymin - t.ymax", "t.ymin - s.ymax")))
    both = target.df.alias("t").join(source.df.alias("s"), F.lit(True)).selectExpr("t.id AS t_id", "s.id AS s_id", f"{far} AS far", f"{gap} AS gap")
    for name, test in (("within", "far <= {0} AND gap < {0}"), ("coveredby", "far <= {0}")):
        want = sorted(map(tuple, both.where(test.format(25)).select("t_id", "s_id").collect()))
        for way in ("broadcast", "shuffle"):
            found = spatial.spatial_pairs(target, source, name, radius=5, strategy=way)
            assert sorted(map(tuple, found.collect())) == want and len(want) > 500
        radii = source.with_df(source.df.withColumn("r", F.lit(5.0)))
        assert sorted(map(tuple, spatial.spatial_pairs(target, radii, name, radius="r").collect())) == want
        hits = {r.id for r in spatial.spatial_filter(target, source, name, radius=5).collect()}
        assert hits == {t for t, _ in want}
        # sides decide before any corner is looked at, and the overlap of the boxes is no test of its own
        condition = spatial._exact((name,), target, source, 5)
        assert condition.index("0.7D * _sr") < condition.index("greatest") and spatial._candidate(target, source, 5, (name,)) == "true"
