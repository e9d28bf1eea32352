"""Registered queries: spatial joins, proximity, disjoint, chains, many targets, exact relations."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosieve.functions import geometry as geo
from geosieve.functions.relate import relation, relation_holds
from geosieve.layer import BoxColumns, Layer, ShapeColumn, once
from geosieve.operators import chains as ch
from geosieve.operators import geometry_jobs as gj
from geosieve.operators import spatial as sp
from geosieve.operators.windows import bucketed_neighbour
from geosieve.plans import layers as ly
from geosieve.plans.registering import register
from geosieve.sizing import settle

col = F.col

GAP = "(t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)"
IN_BOX = "t.x BETWEEN s.xmin AND s.xmax AND t.y BETWEEN s.ymin AND s.ymax"
IN_OPEN_BOX = "t.x > s.xmin AND t.x < s.xmax AND t.y > s.ymin AND t.y < s.ymax"


# --- J1-J4 -----------------------------------------------------------------------------------------


@register("j1_spatial_semi_join", f"""
SELECT o_orderkey, o_totalprice, x, y FROM {ly.ORDER_POINTS} t
WHERE EXISTS (SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey IN (1, 2) AND {ly.in_zone('t.x', 't.y', 's')})""")
def j1(spark, sf_dir):
    zones = ly.zones(spark, sf_dir).where(col("n_regionkey").isin(1, 2))
    return sp.spatial_filter(ly.order_points(spark, sf_dir), zones).select("o_orderkey", "o_totalprice", "x", "y")


@register("j1_lines_in_boxes", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {ly.LINE_POINTS} t
WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s WHERE {IN_BOX})""")
def j1_lines(spark, sf_dir):
    lines = ly.line_points(spark, sf_dir)
    return sp.spatial_filter(lines, ly.part_boxes(spark, sf_dir)).select(*lines.pk)


@register("j1_points_in_part_shapes", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t
WHERE EXISTS (SELECT 1 FROM {ly.PART_SHAPES} s WHERE {ly.in_zone('t.x', 't.y', 's')})""")
def j1_shapes(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.part_shapes(spark, sf_dir)).select("o_orderkey")


@register("j1_boxes_with_points", f"""
SELECT p_partkey FROM {ly.PART_BOXES} s WHERE EXISTS (SELECT 1 FROM {ly.ORDER_POINTS} t WHERE {IN_OPEN_BOX})""")
def j1_boxes(spark, sf_dir):
    """Boxes that contain an order point: the target is the wide side."""
    return sp.spatial_filter(ly.part_boxes(spark, sf_dir), ly.order_points(spark, sf_dir), "contains").select(
        "p_partkey")


@register("j1_within_or_touches", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.ZONES} s
  WHERE {ly.in_zone('t.x', 't.y', 's')} AND NOT {ly.in_zone('t.x', 't.y', 's', closed=False)})""")
def j1_touches(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.zones(spark, sf_dir), "ST_Touches").select("o_orderkey")


@register("j1_no_predicate", "SELECT o_orderkey FROM orders WHERE 1 = 0")
def j1_none(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.zones(spark, sf_dir), ()).select("o_orderkey")


@register("j2_small_source", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {ly.LINE_POINTS} t WHERE EXISTS (
  SELECT 1 FROM {ly.ZONES} s WHERE s.kind = 'holed' AND {ly.in_zone('t.x', 't.y', 's', closed=False)})""")
def j2(spark, sf_dir):
    lines, zones = ly.line_points(spark, sf_dir), ly.zones(spark, sf_dir).where("kind = 'holed'")
    way = "broadcast" if sp.small_source(zones) else "auto"
    return sp.spatial_filter(lines, zones, "within", strategy=way).select(*lines.pk)


@register("j3_select_by_location", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {ly.LINE_POINTS} t
WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s WHERE s.p_size > 40 AND {IN_BOX})""")
def j3(spark, sf_dir):
    lines, boxes = ly.line_points(spark, sf_dir), ly.part_boxes(spark, sf_dir).where("p_size > 40")
    return sp.select_by_location(lines, boxes, ("within", "touches", "overlaps")).select(*lines.pk)


@register("j4_pairs", f"""
SELECT t.o_orderkey AS t_o_orderkey, s.n_nationkey AS s_n_nationkey FROM {ly.ORDER_POINTS} t
JOIN {ly.ZONES} s ON {ly.in_zone('t.x', 't.y', 's')}""")
def j4(spark, sf_dir):
    return sp.spatial_pairs(ly.order_points(spark, sf_dir), ly.zones(spark, sf_dir))


# --- J5-J8 -----------------------------------------------------------------------------------------


@register("j5_proximity", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.SUPPLIER_POINTS} s WHERE {GAP} <= 100)""")
def j5(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.supplier_points(spark, sf_dir), radius=10).select(
        "o_orderkey")


@register("j5_dwithin_boxes", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s WHERE
  greatest(s.xmin - t.x, t.x - s.xmax, 0) ** 2 + greatest(s.ymin - t.y, t.y - s.ymax, 0) ** 2 <= 9)""")
def j5_boxes(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.part_boxes(spark, sf_dir), "dwithin", radius=3).select("o_orderkey")


def _edge_gap_sq() -> str:
    """SQL: squared distance of a point t from the nearest edge of a zone s, over its corners."""
    corners = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {a[0]} AS px, {a[1]} AS py, {b[0]} AS qx, {b[1]} AS qy"
        for kind, rings in ly.CORNERS.items() for ring in rings for a, b in zip(ring, ring[1:]))
    # all edges are parallel to an axis, so the nearest point of an edge is a clamp
    return (f"(SELECT min((t.x - least(greatest(t.x, s.x0 + least(px, qx) * s.unit), s.x0 + greatest(px, qx) * s.unit))"
            f" ** 2 + (t.y - least(greatest(t.y, s.y0 + least(py, qy) * s.unit), s.y0 + greatest(py, qy) * s.unit))"
            f" ** 2) FROM ({corners}) e WHERE e.kind = s.kind)")


@register("j5_near_zones", f"""
SELECT DISTINCT t.o_orderkey FROM {ly.ORDER_POINTS} t JOIN {ly.ZONES} s ON s.n_regionkey = 3
WHERE {ly.in_zone('t.x', 't.y', 's')} OR {_edge_gap_sq()} <= 25""")
def j5_zones(spark, sf_dir):
    zones = ly.zones(spark, sf_dir).where("n_regionkey = 3")
    return sp.spatial_filter(ly.order_points(spark, sf_dir), zones, radius=5.0).select("o_orderkey")


@register("j6_row_radius_pairs", f"""
SELECT t.o_orderkey AS t_o_orderkey, s.s_suppkey AS s_s_suppkey FROM {ly.ORDER_POINTS} t
JOIN {ly.SUPPLIER_POINTS} s ON {GAP} <= s.radius * s.radius""")
def j6_pairs(spark, sf_dir):
    return sp.spatial_pairs(ly.order_points(spark, sf_dir), ly.supplier_points(spark, sf_dir), radius="radius")


@register("j6_radius_expression", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.SUPPLIER_POINTS} s
  WHERE {GAP} <= (CASE WHEN s.s_acctbal > 5000 THEN 50 ELSE 1 END) ** 2)""")
def j6_expression(spark, sf_dir):
    radius = F.when(col("s_acctbal") > 5000, 50).otherwise(1)
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.supplier_points(spark, sf_dir), radius=radius).select(
        "o_orderkey")


@register("j7_erosion", f"""
SELECT DISTINCT t.o_orderkey FROM {ly.ORDER_POINTS} t JOIN {ly.ZONES} s ON {ly.in_zone('t.x', 't.y', 's')}
WHERE {_edge_gap_sq()} >= 225""")
def j7(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.zones(spark, sf_dir), radius=-15).select("o_orderkey")


@register("j7_erosion_boxes", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s
  WHERE s.xmax - s.xmin > 6 AND s.ymax - s.ymin > 6 AND t.x BETWEEN s.xmin + 3 AND s.xmax - 3
  AND t.y BETWEEN s.ymin + 3 AND s.ymax - 3)""")
def j7_boxes(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.part_boxes(spark, sf_dir), radius=-3).select("o_orderkey")


@register("j8_disjoint_all", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t
WHERE NOT EXISTS (SELECT 1 FROM {ly.PART_BOXES} s WHERE {IN_BOX})""")
def j8_all(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.part_boxes(spark, sf_dir), "disjoint", mode="all").select(
        "o_orderkey")


@register("j8_disjoint_any", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t
WHERE EXISTS (SELECT 1 FROM {ly.ZONES} s WHERE {GAP.replace('s.x', '(s.x0 + 100)').replace('s.y', '(s.y0 + 100)')} > 490000)""")
def j8_any(spark, sf_dir):
    """Discs around all zone centres: only points in every one are left out."""
    zones = ly.zones(spark, sf_dir)
    centres = Layer(zones.df.withColumns({"cx": col("x0") + 100, "cy": col("y0") + 100}), zones.pk,
                    ly.PointColumns("cx", "cy"), zones.crs)
    return sp.spatial_filter(ly.order_points(spark, sf_dir), centres, "disjoint", radius=700).select("o_orderkey")


@register("j8_disjoint_or_touches", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE NOT EXISTS (
  SELECT 1 FROM {ly.ZONES} s WHERE {ly.in_zone('t.x', 't.y', 's')})
OR EXISTS (SELECT 1 FROM {ly.ZONES} s WHERE {ly.in_zone('t.x', 't.y', 's')}
  AND NOT {ly.in_zone('t.x', 't.y', 's', closed=False)})""")
def j8_touches(spark, sf_dir):
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.zones(spark, sf_dir), ("disjoint", "touches"),
                             mode="all").select("o_orderkey")


# --- J9-J12 ----------------------------------------------------------------------------------------


@register("j9_many_targets", f"""
SELECT 'orders' AS layer, count(*) AS n FROM {ly.ORDER_POINTS} t WHERE EXISTS (
  SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey = 2 AND {ly.in_zone('t.x', 't.y', 's')})
UNION ALL SELECT 'lines', count(*) FROM {ly.LINE_POINTS} t WHERE EXISTS (
  SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey = 2 AND {ly.in_zone('t.x', 't.y', 's')})
UNION ALL SELECT 'suppliers', count(*) FROM {ly.SUPPLIER_POINTS} t WHERE EXISTS (
  SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey = 2 AND {ly.in_zone('t.x', 't.y', 's')})""")
def j9(spark, sf_dir):
    targets = {"orders": ly.order_points(spark, sf_dir), "lines": ly.line_points(spark, sf_dir),
               "suppliers": ly.supplier_points(spark, sf_dir)}
    found = sp.filter_many(targets, ly.zones(spark, sf_dir).where("n_regionkey = 2"))
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("layer"), F.count("*").alias("n"))
                                    for name, df in found.items()])


@register("j10_chain_target", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t
WHERE EXISTS (SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey IN (0, 1, 2) AND {ly.in_zone('t.x', 't.y', 's')})
  AND EXISTS (SELECT 1 FROM {ly.SUPPLIER_POINTS} s WHERE {GAP} <= 400)""")
def j10(spark, sf_dir):
    steps = [ch.SpatialStep(ly.zones(spark, sf_dir).where("n_regionkey IN (0, 1, 2)")),
             ch.SpatialStep(ly.supplier_points(spark, sf_dir), radius=20)]
    return ch.chain(ly.order_points(spark, sf_dir), steps, "target").select("o_orderkey")


@register("j11_chain_source", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.SUPPLIER_POINTS} s WHERE {GAP} <= 400
  AND EXISTS (SELECT 1 FROM {ly.ZONES} z WHERE z.n_regionkey IN (0, 1, 2) AND {ly.in_zone('s.x', 's.y', 'z')}))""")
def j11(spark, sf_dir):
    steps = [ch.SpatialStep(ly.zones(spark, sf_dir).where("n_regionkey IN (0, 1, 2)")),
             ch.SpatialStep(ly.supplier_points(spark, sf_dir), radius=20)]
    return ch.chain(ly.order_points(spark, sf_dir), steps, "source").select("o_orderkey")


@register("j12_chain_with_custom", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE o_orderstatus = 'F'
  AND EXISTS (SELECT 1 FROM {ly.SUPPLIER_POINTS} s WHERE {GAP} <= s.radius * s.radius AND s.s_acctbal > 2000
  AND EXISTS (SELECT 1 FROM {ly.ZONES} z WHERE z.n_regionkey < 4 AND {ly.in_zone('s.x', 's.y', 'z')}))""")
def j12(spark, sf_dir):
    steps = [ch.SpatialStep(ly.zones(spark, sf_dir).where("n_regionkey < 4")),
             ch.SpatialStep(ly.supplier_points(spark, sf_dir), radius="radius")]
    target = ly.order_points(spark, sf_dir).where("o_orderstatus = 'F'")
    return ch.chain(target, steps, "source", custom="s_acctbal > 2000").select("o_orderkey")


# --- G14, G15 --------------------------------------------------------------------------------------


@register("g14_tiles", f"""
SELECT p_partkey, cx, cy FROM {ly.PART_BOXES} t,
  unnest(generate_series(CAST(floor(xmin / 25) AS BIGINT), CAST(floor(xmax / 25) AS BIGINT))) AS a(cx),
  unnest(generate_series(CAST(floor(ymin / 25) AS BIGINT), CAST(floor(ymax / 25) AS BIGINT))) AS b(cy)""")
def g14(spark, sf_dir):
    return gj.tile(ly.part_boxes(spark, sf_dir), 25)


MEET = "t.xmin <= s.xmax AND t.xmax >= s.xmin AND t.ymin <= s.ymax AND t.ymax >= s.ymin"
INNER = "t.xmin < s.xmax AND t.xmax > s.xmin AND t.ymin < s.ymax AND t.ymax > s.ymin"
COVERS = "t.xmin <= s.xmin AND t.xmax >= s.xmax AND t.ymin <= s.ymin AND t.ymax >= s.ymax"
COVERED = "s.xmin <= t.xmin AND s.xmax >= t.xmax AND s.ymin <= t.ymin AND s.ymax >= t.ymax"
BOX_SQL = {
    "intersects": MEET, "contains": COVERS, "covers": COVERS, "within": COVERED, "coveredby": COVERED,
    "equals": f"{COVERS} AND {COVERED}", "touches": f"{MEET} AND NOT ({INNER})",
    "overlaps": f"{INNER} AND NOT ({COVERS}) AND NOT ({COVERED})", "crosses": "1 = 0",
}

for _predicate, _sql in BOX_SQL.items():
    def _box_pairs(spark, sf_dir, predicate=_predicate):
        boxes = ly.part_boxes(spark, sf_dir)
        return sp.spatial_pairs(boxes, boxes, predicate)

    register(f"g15_box_{_predicate}", f"""
SELECT t.p_partkey AS t_p_partkey, s.p_partkey AS s_p_partkey FROM {ly.PART_BOXES} t
JOIN {ly.PART_BOXES} s ON {_sql}""")(_box_pairs)


def _carrying(boxes: Layer) -> Layer:
    """Part boxes that carry the boxes of all rows of their key, so that pairs need no join to get shapes."""
    same = F.collect_list(F.struct(*boxes.geometry.columns)).over(Window.partitionBy("p_partkey"))
    return replace(boxes, df=boxes.df.where("p_partkey IS NOT NULL").withColumn("same", same), pk=("p_partkey", "same"))


def _box_shapes(pairs: DataFrame, t_name: str, s_name: str) -> DataFrame:
    """Pairs of parts with the shapes of the boxes they carry, spread evenly."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = lambda side: BoxColumns(*[f"{side}.{c}" for c in BoxColumns().columns]).shape()
    both = pairs.repartition(n, "t_p_partkey", "s_p_partkey").selectExpr("*", "explode(t_same) AS t").selectExpr(
        "*", "explode(s_same) AS s")
    return both.select(col("t_p_partkey").alias("t_key"), col("s_p_partkey").alias("s_key"), shape("t").alias(t_name),
                       shape("s").alias(s_name))


@register("g15_shape_relations", f"""
SELECT t.p_partkey AS t_key, s.p_partkey AS s_key, {', '.join(f'({q}) AS {p}' for p, q in BOX_SQL.items())}
FROM {ly.PART_BOXES} t JOIN {ly.PART_BOXES} s ON {MEET}""")
def g15_shapes(spark, sf_dir):
    """All predicates of the general kernel on rectangles, where closed forms can check them."""
    boxes = ly.part_boxes(spark, sf_dir)
    pairs = _box_shapes(sp.spatial_pairs(_carrying(boxes), _carrying(boxes)), "t_geom", "s_geom")
    related = once(pairs, "m", relation(col("t_geom"), col("s_geom")))
    return related.select("t_key", "s_key", *[relation_holds(p, col("m")).alias(p) for p in BOX_SQL])


def event_lines(spark, sf_dir) -> Layer:
    """A line from each event of a user to the next one."""
    events = ly.event_points(ly.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")).df
    day = F.floor(F.unix_timestamp("ts") / 86400)
    following = bucketed_neighbour(events, ["user_id"], ["ts", "event_id"], day, {"x2": "x", "y2": "y"}, step=1)
    lines = following.where(col("x2").isNotNull())
    line = geo.make_line((col("x"), col("y")), (col("x2"), col("y2")))
    return Layer(lines.withColumn("geom", line), ("event_id",), ShapeColumn(), ly.PLANE, "event_lines")


EVENT_LINES = f"""(SELECT * FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {ly.EVENT_POINTS} p
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x2 IS NOT NULL)"""

# a segment meets an axis-parallel box when its boxes overlap and the corners are not all on one side of it
SEGMENT_IN_BOX = """least(t.x, t.x2) <= s.xmax AND greatest(t.x, t.x2) >= s.xmin AND least(t.y, t.y2) <= s.ymax
  AND greatest(t.y, t.y2) >= s.ymin AND
  NOT (least({0}) > 0 OR greatest({0}) < 0)""".format(", ".join(
    f"(t.x2 - t.x) * (s.{y} - t.y) - (t.y2 - t.y) * (s.{x} - t.x)" for x in ("xmin", "xmax") for y in ("ymin", "ymax")))


@register("g15_lines_meet_boxes", f"""
SELECT DISTINCT t.event_id FROM {EVENT_LINES} t JOIN {ly.PART_BOXES} s ON {SEGMENT_IN_BOX}""")
def g15_lines(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    lines = lines.with_df(settle(lines.df.select("event_id", "geom")))  # read by each step of the plan and by the join
    return sp.spatial_filter(lines, ly.part_boxes(spark, sf_dir)).select("event_id")


# every shape is a few rectangles without overlap, so areas of intersections are sums over their pairs
SHAPE_AREAS = f"""
WITH r(kind, a, b, c, d) AS (VALUES ('square', 1, 1, 19, 19), ('ell', 1, 1, 19, 9), ('ell', 1, 9, 9, 19),
  ('holed', 1, 1, 19, 6), ('holed', 1, 14, 19, 19), ('holed', 1, 6, 6, 14), ('holed', 14, 6, 19, 14)),
p AS (SELECT p_partkey AS k, x0 + a * unit AS x1, y0 + b * unit AS y1, x0 + c * unit AS x2, y0 + d * unit AS y2
  FROM {ly.PART_SHAPES} s JOIN r ON r.kind = s.kind),
area AS (SELECT k, sum((x2 - x1) * (y2 - y1)) AS area FROM p GROUP BY 1),
shared AS (SELECT t.k AS tk, s.k AS sk, sum((least(t.x2, s.x2) - greatest(t.x1, s.x1)) *
    (least(t.y2, s.y2) - greatest(t.y1, s.y1))) AS inter
  FROM p t JOIN p s ON t.x1 < s.x2 AND s.x1 < t.x2 AND t.y1 < s.y2 AND s.y1 < t.y2 GROUP BY 1, 2)
SELECT tk AS t_p_partkey, sk AS s_p_partkey FROM shared JOIN area ta ON ta.k = tk JOIN area sa ON sa.k = sk
WHERE inter > 1e-9"""


@register("g15_shapes_overlap_or_contain", f"""{SHAPE_AREAS}
  AND (inter >= sa.area * (1 - 1e-9) OR inter < ta.area * (1 - 1e-9))""")
def g15_overlap(spark, sf_dir):
    """L-shaped, holed and square parts against each other, with the general kernel."""
    shapes = ly.part_shapes(spark, sf_dir)
    return sp.spatial_pairs(shapes, shapes, ("overlaps", "contains"))


@register("g15_shapes_within", f"{SHAPE_AREAS} AND inter >= ta.area * (1 - 1e-9)")
def g15_within(spark, sf_dir):
    shapes = ly.part_shapes(spark, sf_dir)
    return sp.spatial_pairs(shapes, shapes, "within")


@register("g9_distances", f"""
SELECT t.p_partkey AS t_key, s.p_partkey AS s_key, round(sqrt(
  greatest(s.xmin - t.xmax, t.xmin - s.xmax, 0) ** 2 + greatest(s.ymin - t.ymax, t.ymin - s.ymax, 0) ** 2), 6) AS distance
FROM {ly.PART_BOXES} t JOIN {ly.PART_BOXES} s ON
  greatest(s.xmin - t.xmax, t.xmin - s.xmax, 0) ** 2 + greatest(s.ymin - t.ymax, t.ymin - s.ymax, 0) ** 2 <= 4""")
def g9(spark, sf_dir):
    boxes = ly.part_boxes(spark, sf_dir)
    both = _box_shapes(sp.spatial_pairs(_carrying(boxes), _carrying(boxes), radius=2), "a", "b")
    return gj.distances(both, "a", "b").select("t_key", "s_key", F.round("distance", 6).alias("distance"))


@register("g5_metric_radius", f"""
WITH m AS (SELECT o_orderkey, o_orderstatus, lon * (6378137.0 * pi() / 180) AS x,
  ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137.0 AS y FROM {ly.LONLAT_POINTS} l)
SELECT t.o_orderkey FROM m t WHERE EXISTS (SELECT 1 FROM m s WHERE s.o_orderstatus = 'P'
  AND s.x BETWEEN t.x - 20000 AND t.x + 20000 AND {GAP} <= 20000.0 * 20000.0 AND s.o_orderkey <> t.o_orderkey)
  OR t.o_orderstatus = 'P'""")
def g5(spark, sf_dir):
    """Order positions within 20 km (in Mercator metres) of a pending one, itself included."""
    layer = ly.lonlat_points(spark, sf_dir)
    return sp.spatial_filter(layer, layer.where("o_orderstatus = 'P'"), radius=20000, metric=True).select("o_orderkey")


# Kruger's series around the pending order's meridian, with the scale averaged over the way
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_RECTIFYING = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_NORTH, _EAST, _START = (" + ".join(terms) for terms in (
    ["up", *[f"{a!r}::DOUBLE * sin({2 * j} * up) * cosh({2 * j} * out)" for j, a in enumerate(_A, 1)]],
    ["out", *[f"{a!r}::DOUBLE * cos({2 * j} * up) * sinh({2 * j} * out)" for j, a in enumerate(_A, 1)]],
    ["base", *[f"{a!r}::DOUBLE * sin({2 * j} * base)" for j, a in enumerate(_A, 1)]]))


def _psi(lat: str) -> str:
    e = (_F * (2 - _F)) ** 0.5
    return f"(atanh(sin(radians({lat}))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians({lat}))))"


@register("g5_geodesic_radius", f"""
WITH p AS (SELECT s.o_orderkey AS s_key, t.o_orderkey AS t_key, {_psi('t.lat')} AS psi, {_psi('s.lat')} AS start,
  radians(t.lon - s.lon) AS turn FROM {ly.LONLAT_POINTS} t JOIN {ly.LONLAT_POINTS} s ON s.o_orderstatus = 'P'
  AND abs(t.lat - s.lat) < 0.3),
a AS (SELECT *, atan2(sinh(psi), cos(turn)) AS up, asinh(sin(turn) / sqrt(sinh(psi) ** 2 + cos(turn) ** 2)) AS out,
  atan(sinh(start)) AS base FROM p WHERE cos(turn) > 0.9),
m AS (SELECT t_key, s_key, ({_NORTH} - ({_START})) * {_RECTIFYING!r}::DOUBLE AS n, ({_EAST}) * {_RECTIFYING!r}::DOUBLE AS e FROM a)
SELECT t_key, s_key FROM m WHERE sqrt(n * n + e * e) / (1 + e * e / (6 * 6371008.8::DOUBLE ** 2)) <= 25000""")
def g5_geodesic(spark, sf_dir):
    """Order positions within 25 km on the ellipsoid of a pending one, whatever the latitude or side of the date line."""
    layer = ly.lonlat_points(spark, sf_dir)
    pairs = sp.spatial_pairs(layer, layer.where("o_orderstatus = 'P'"), radius=25000, metric="geodesic")
    return pairs.select(col("t_o_orderkey").alias("t_key"), col("s_o_orderkey").alias("s_key"))


@register("g7_centroid_targets", f"""
SELECT p_partkey FROM {ly.PART_BOXES} b WHERE EXISTS (SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey = 1
  AND {ly.in_zone('((b.xmin + b.xmax) / 2)', '((b.ymin + b.ymax) / 2)', 's')})""")
def g7_targets(spark, sf_dir):
    zones = ly.zones(spark, sf_dir).where("n_regionkey = 1")
    return sp.spatial_filter(ly.part_boxes(spark, sf_dir), zones, use_centroids="target", point_mode="centroid").select(
        "p_partkey")


@register("j8_disjoint_any_eroded", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s
  WHERE s.xmax - s.xmin > 12 AND s.ymax - s.ymin > 12 AND NOT (t.x BETWEEN s.xmin + 6 AND s.xmax - 6
  AND t.y BETWEEN s.ymin + 6 AND s.ymax - 6))""")
def j8_eroded(spark, sf_dir):
    """Most boxes vanish when shrunk; they are not sources that a point could be apart from."""
    return sp.spatial_filter(ly.order_points(spark, sf_dir), ly.part_boxes(spark, sf_dir), "disjoint", radius=-6).select(
        "o_orderkey")


@register("j7_eroded_boxes", f"""
SELECT p_partkey FROM {ly.PART_BOXES} t WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s
  WHERE s.xmax - s.xmin > 8 AND s.ymax - s.ymin > 8 AND s.p_partkey % 3 = 0
  AND t.xmin <= s.xmax - 4 AND t.xmax >= s.xmin + 4 AND t.ymin <= s.ymax - 4 AND t.ymax >= s.ymin + 4)""")
def j7_boxes(spark, sf_dir):
    """Boxes that reach four units or more into one of a third of the boxes."""
    boxes = ly.part_boxes(spark, sf_dir)
    return sp.spatial_filter(boxes, boxes.where("p_partkey % 3 = 0"), radius=-4).select("p_partkey")


@register("j5_within_grown_boxes", f"""
SELECT t.p_partkey AS t_p_partkey, s.p_partkey AS s_p_partkey FROM {ly.PART_BOXES} t JOIN {ly.PART_BOXES} s
  ON greatest(s.xmin - t.xmin, t.xmax - s.xmax, 0) ** 2 + greatest(s.ymin - t.ymin, t.ymax - s.ymax, 0) ** 2 <= 25""")
def j5_within(spark, sf_dir):
    """Boxes that lie wholly within five units of another."""
    boxes = ly.part_boxes(spark, sf_dir)
    return sp.spatial_pairs(boxes, boxes, "within", radius=5)


@register("j5_contains_grown_boxes", f"""
SELECT p_partkey FROM {ly.PART_BOXES} t WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s
  WHERE t.xmin <= s.xmin - 3 AND t.xmax >= s.xmax + 3 AND t.ymin <= s.ymin - 3 AND t.ymax >= s.ymax + 3)""")
def j5_contains(spark, sf_dir):
    """Boxes that hold another with three units to spare."""
    boxes = ly.part_boxes(spark, sf_dir)
    return sp.spatial_filter(boxes, boxes, "contains", radius=3).select("p_partkey")


# --- flat boxes and point shapes ---------------------------------------------------------------------


def _flat(spark, sf_dir, every: int) -> Layer:
    """Part boxes, of which some are cut down to their left and some to their lower side."""
    boxes = ly.part_boxes(spark, sf_dir)
    rest = col("p_partkey") % every
    return boxes.with_df(boxes.df.withColumns({
        "xmax": F.when(rest == 1, col("xmin")).otherwise(col("xmax")),
        "ymax": F.when(rest == 2, col("ymin")).otherwise(col("ymax"))}))


def _flat_sql(every: int) -> str:
    return (f"(SELECT p_partkey, xmin, ymin, if(p_partkey % {every} = 1, xmin, xmax) AS xmax, "
            f"if(p_partkey % {every} = 2, ymin, ymax) AS ymax FROM {ly.PART_BOXES} p)")


def _insides(c: str) -> str:
    t0, t1, s0, s1 = f"t.{c}min", f"t.{c}max", f"s.{c}min", f"s.{c}max"
    return (f"CASE WHEN {t0} = {t1} AND {s0} = {s1} THEN {t0} = {s0} WHEN {t0} = {t1} THEN {t0} > {s0} AND {t0} < {s1} "
            f"WHEN {s0} = {s1} THEN {s0} > {t0} AND {s0} < {t1} ELSE {t0} < {s1} AND {s0} < {t1} END")


_T_IN_S = "t.xmin >= s.xmin AND t.xmax <= s.xmax AND t.ymin >= s.ymin AND t.ymax <= s.ymax"
_S_IN_T = "s.xmin >= t.xmin AND s.xmax <= t.xmax AND s.ymin >= t.ymin AND s.ymax <= t.ymax"
_MEET = "t.xmin <= s.xmax AND t.xmax >= s.xmin AND t.ymin <= s.ymax AND t.ymax >= s.ymin"
_INNER = f"({_insides('x')}) AND ({_insides('y')})"
_DIM = "((({0}.xmax > {0}.xmin)::INT) + (({0}.ymax > {0}.ymin)::INT))"
_DIMS = f"{_DIM.format('t')}, {_DIM.format('s')}"
_SAME_WAY = "(t.xmax > t.xmin) = (s.xmax > s.xmin) AND (t.ymax > t.ymin) = (s.ymax > s.ymin)"
FLAT = {
    "intersects": _MEET,
    "touches": f"{_MEET} AND NOT ({_INNER})",
    "within": f"{_T_IN_S} AND {_INNER}",
    "contains": f"{_S_IN_T} AND {_INNER}",
    "covers": _S_IN_T,
    "coveredby": _T_IN_S,
    "equals": f"{_T_IN_S} AND {_S_IN_T}",
    "overlaps": f"{_SAME_WAY} AND {_INNER} AND NOT ({_T_IN_S}) AND NOT ({_S_IN_T})",
    "crosses": f"{_INNER} AND (({_DIMS}) IN ((1, 2), (2, 1)) AND NOT ({_T_IN_S}) AND NOT ({_S_IN_T}) "
               f"OR ({_DIMS}) = (1, 1) AND NOT ({_SAME_WAY}))",
}


def _register_flat(name: str, test: str) -> None:
    @register(f"g15_flat_boxes_{name}", f"""
SELECT t.p_partkey AS t_p_partkey, s.p_partkey AS s_p_partkey FROM {_flat_sql(3)} t, {_flat_sql(4)} s WHERE {test}""")
    def pairs(spark, sf_dir):
        return sp.spatial_pairs(_flat(spark, sf_dir, 3), _flat(spark, sf_dir, 4), name)


for _name, _test in FLAT.items():
    _register_flat(_name, _test)


def _register_points(name: str, shape_first: bool) -> None:
    side = "shape_points" if shape_first else "point_shapes"

    @register(f"g15_{side}_{name}", f"""
SELECT o_orderkey FROM {ly.ORDER_POINTS} t WHERE EXISTS (SELECT 1 FROM {ly.LINE_POINTS} s WHERE t.x = s.x AND t.y = s.y)""")
    def found(spark, sf_dir):
        target, source = ly.order_points(spark, sf_dir), ly.line_points(spark, sf_dir)
        target, source = (target.as_shapes(), source) if shape_first else (target, source.as_shapes())
        return sp.spatial_filter(target, source, name).select("o_orderkey")


for _name in ("intersects", "equals", "contains", "within", "covers", "coveredby"):
    _register_points(_name, False)
    _register_points(_name, True)
