"""How many candidates a join looks at, and that rows with equal or missing keys are judged one by one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from geosieve.functions import geometry as geo
from geosieve.layer import BoxColumns, Layer, PointColumns, ShapeColumn
from geosieve.operators import spatial


def boxes(spark, rows) -> Layer:
    return Layer(spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double"), ("id",), BoxColumns())


def some_boxes(spark, n: int, sides) -> Layer:
    return boxes(spark, [(i, float(i * 37 % 200), float(i * 53 % 200), float(i * 37 % 200 + sides[i % len(sides)]),
                          float(i * 53 % 200 + 1 + i % 3)) for i in range(n)])


def test_filter_on_several_levels_stops_at_the_first_match(spark):
    target = some_boxes(spark, 60, (2, 60))
    points = spark.createDataFrame([(i, float(i * 7 % 250), float(i * 11 % 250)) for i in range(300)], "pid long, x double, y double")
    source = Layer(points, ("pid",), PointColumns())
    plan = spatial.plan_join(target, source, strategy="shuffle")
    assert len(plan.levels) > 1 and plan.strategy == "shuffle"
    found = spatial.spatial_filter(target, source, "intersects", plan=plan)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {r.id for r in target.df.join(points, F.expr("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")).collect()}
    assert {r.id for r in found.collect()} == want


def test_cells_follow_the_measured_sides_and_the_predicate(spark):
    layer = some_boxes(spark, 80, (5, 50))
    plan = replace(spatial.plan_join(layer, layer, strategy="shuffle"), current=True)
    side = spatial._source_side(layer, None, False, plan)
    n = {name: spatial._tiles(side, plan, plan.levels[-1], False, (name,)).count()
         for name in ("intersects", "within", "equals")}
    coarse = spatial._tiles(side, replace(plan, sides=()), plan.levels[-1], False).count()
    assert n["equals"] < n["within"] < n["intersects"] < coarse
    rows = [tuple(r) for r in layer.df.collect()]
    for name, holds in {
            "intersects": lambda t, s: t[1] <= s[3] and t[3] >= s[1] and t[2] <= s[4] and t[4] >= s[2],
            "within": lambda t, s: s[1] <= t[1] and t[3] <= s[3] and s[2] <= t[2] and t[4] <= s[4],
            "covers": lambda t, s: t[1] <= s[1] and s[3] <= t[3] and t[2] <= s[2] and s[4] <= t[4],
            "equals": lambda t, s: t[1:] == s[1:]}.items():
        got = {tuple(r) for r in spatial.spatial_pairs(layer, layer, name, plan=plan).collect()}
        assert got == {(t[0], s[0]) for t in rows for s in rows if holds(t, s)}, name


def test_levels_without_sources_match_larger_targets_only(spark):
    plan = spatial.JoinPlan((1,), (1, 5), 2, "broadcast")
    assert plan.joins(1) == "_tlvl <= 1" and plan.joins(5) == "_tlvl = 5"
    target = some_boxes(spark, 40, (3, 900)).with_df(some_boxes(spark, 40, (3, 900)).df)
    source = some_boxes(spark, 20, (3,))
    got = {r.id for r in spatial.spatial_filter(target, source, plan=plan).collect()}
    near = "t.xmin <= s.xmax AND t.xmax >= s.xmin AND t.ymin <= s.ymax AND t.ymax >= s.ymin"
    want = {r.id for r in target.df.alias("t").join(source.df.alias("s"), F.expr(near)).select("t.id").collect()}
    assert got == want


def test_long_lines_are_cut_for_candidates_only(spark):
    rows = [(i, float(i * 37 % 900), float(i * 53 % 900), float(i * 71 % 900), float(i * 91 % 900)) for i in range(60)]
    rows += [(100, 0.0, 0.0, 900.0, 0.0), (101, 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    line = geo.make_line((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    target = Layer(df.withColumn("geom", line), ("id",), ShapeColumn())
    source = some_boxes(spark, 80, (2, 30))
    plan = replace(spatial.plan_join(target, source, strategy="shuffle"), current=True)
    assert len(plan.levels) > 1
    cut = spatial._cut_lines(target, source, plan)
    area = lambda layer: spatial._target_side(layer, False).agg(F.expr("sum((_tx1 - _tx0) * (_ty1 - _ty0))")).first()[0]
    assert area(cut) < area(target) / 4
    found = {r.id for r in spatial.spatial_filter(target, source, plan=plan).collect()}
    apart = {r.id for r in spatial.spatial_filter(target, source, "disjoint", mode="all", plan=plan).collect()}
    side = lambda x, y: f"((t.x2 - t.x1) * (s.{y} - t.y1) - (t.y2 - t.y1) * (s.{x} - t.x1))"
    sides = ", ".join(side(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax"))
    meet = ("least(t.x1, t.x2) <= s.xmax AND greatest(t.x1, t.x2) >= s.xmin AND least(t.y1, t.y2) <= s.ymax AND "
            f"greatest(t.y1, t.y2) >= s.ymin AND NOT (least({sides}) > 0 OR greatest({sides}) < 0)")
    want = {r.id for r in df.alias("t").join(source.df.alias("s"), F.expr(meet)).select("t.id").collect()}
    assert found == want and apart == {r[0] for r in rows} - want and want
