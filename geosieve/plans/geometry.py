"""Registered queries: geometry jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.functions import crs
from geosieve.functions import geometry as geo
from geosieve.functions.predicates import odd_crossings, on_any_edge
from geosieve.layer import Layer, ShapeColumn, once
from geosieve.operators import geometry_jobs as gj
from geosieve.operators.spatial import as_points
from geosieve.plans import layers as ly
from geosieve.plans.registering import register
from geosieve.plans.spatial import EVENT_LINES, event_lines

col = F.col


def rounded(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


# --- G1, G2 ----------------------------------------------------------------------------------------

# every seventh text is broken in one of several ways
BROKEN = """CASE o_orderkey % 7 WHEN 3 THEN 'POINT (' || x || ')' WHEN 5 THEN 'PIONT (1 2)' ELSE
  'POINT (' || x || ' ' || y || ')' END"""


@register("g1_wkt_ingest", f"SELECT o_orderkey, x, y FROM {ly.ORDER_POINTS} t WHERE o_orderkey % 7 NOT IN (3, 5)")
def g1(spark, sf_dir):
    df = ly.order_points(spark, sf_dir).df.withColumn("wkt", F.expr(BROKEN)).select("o_orderkey", "wkt")
    good, _ = gj.ingest_wkt(df, "wkt")
    point = geo.start_point(col("geom"))
    return good.select("o_orderkey", point["x"].alias("x"), point["y"].alias("y"))


@register("g1_wkt_quarantine", f"""
SELECT o_orderkey, {BROKEN} AS wkt FROM {ly.ORDER_POINTS} t WHERE o_orderkey % 7 IN (3, 5)""")
def g1_bad(spark, sf_dir):
    df = ly.order_points(spark, sf_dir).df.withColumn("wkt", F.expr(BROKEN)).select("o_orderkey", "wkt")
    return gj.ingest_wkt(df, "wkt")[1]


def _wkt_number(v: str) -> str:
    return f"regexp_replace(printf('%.3f', {v}), '\\.?0+$', '')"


@register("g1_wkt_roundtrip", f"""
SELECT p_partkey, CASE kind WHEN 'ell' THEN 7 WHEN 'holed' THEN 10 ELSE 5 END AS n_vertices,
  CASE kind WHEN 'holed' THEN 2 ELSE 1 END AS n_rings, round(x0 + unit, 3) AS xmin, round(y0 + 19 * unit, 3) AS ymax
FROM {ly.PART_SHAPES} t""")
def g1_roundtrip(spark, sf_dir):
    """Polygons written as WKT and read back."""
    texts = gj.with_wkt(ly.part_shapes(spark, sf_dir)).select("p_partkey", "wkt")
    back, _ = gj.ingest_wkt(texts, "wkt")
    xmin, _, _, ymax = geo.bbox(col("geom"))
    return back.select("p_partkey", geo.num_points(col("geom")).alias("n_vertices"),
                       F.size(geo.rings(col("geom"))).alias("n_rings"), F.round(xmin, 3).alias("xmin"),
                       F.round(ymax, 3).alias("ymax"))


def damaged_shapes(spark, sf_dir) -> Layer:
    """Part shapes of which some are missing, empty, open, too short or hold a NaN."""
    layer = ly.part_shapes(spark, sf_dir)
    parts = col("geom")["parts"]
    nan = F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, lambda p, i: F.struct(
        F.when(i == 1, F.lit(float("nan"))).otherwise(p["x"]).alias("x"), p["y"].alias("y")))))
    cut = F.transform(parts, lambda part: F.transform(part, lambda r: F.slice(r, 1, F.size(r) - 1)))
    short = F.transform(parts, lambda part: F.transform(part, lambda r: F.slice(r, 1, 3)))
    none = F.filter(parts, lambda p: F.lit(False))
    kind = col("p_partkey") % 11
    changed = F.when(kind == 1, none).when(kind == 2, nan).when(kind == 3, cut).when(kind == 4, short).otherwise(parts)
    df = layer.df.withColumn("geom", F.when(kind != 0, F.struct(F.lit("POLYGON").alias("type"), changed.alias("parts"))))
    return layer.with_df(df)


@register("g2_validity", f"""
SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'null' WHEN 1 THEN 'empty' WHEN 2 THEN 'not finite'
  WHEN 3 THEN 'ring not closed' WHEN 4 THEN 'too few vertices' END AS issue FROM {ly.PART_SHAPES} t""")
def g2(spark, sf_dir):
    # a square cut by one vertex still has four of them
    return gj.check(damaged_shapes(spark, sf_dir)).select("p_partkey", "issue")


@register("g2_drop_invalid", "SELECT p_partkey FROM part WHERE p_partkey % 11 > 4")
def g2_drop(spark, sf_dir):
    return gj.drop_invalid(damaged_shapes(spark, sf_dir)).df.select("p_partkey")


@register("g2b_repair", f"""
SELECT p_partkey, CASE WHEN p_partkey % 11 IN (0, 1) THEN 'none' WHEN p_partkey % 11 <= 4 THEN 'hull' END AS repair_kind,
  p_partkey % 11 > 1 AS usable FROM {ly.PART_SHAPES} t""")
def g2b(spark, sf_dir):
    fixed = gj.repair(damaged_shapes(spark, sf_dir))
    return fixed.select("p_partkey", "repair_kind", geo.is_valid(col("geom")).alias("usable"))


# --- G3, G4 ----------------------------------------------------------------------------------------


@register("g3_reproject", f"""
SELECT o_orderkey, round(lon * (6378137.0 * pi() / 180), 4) AS lon,
  round(ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137.0, 4) AS lat FROM {ly.LONLAT_POINTS} t""")
def g3(spark, sf_dir):
    moved = crs.reproject(ly.lonlat_points(spark, sf_dir), crs.METRIC)
    return moved.df.select("o_orderkey", *rounded("lon", "lat", digits=4))


@register("g3_there_and_back", f"SELECT o_orderkey, round(lon, 8) AS lon, round(lat, 8) AS lat FROM {ly.LONLAT_POINTS} t")
def g3_back(spark, sf_dir):
    layer = ly.lonlat_points(spark, sf_dir)
    back = crs.reproject(crs.reproject(layer, crs.METRIC), crs.GEOGRAPHIC)
    return back.df.select("o_orderkey", *rounded("lon", "lat", digits=8))


@register("g4_utm_zone", f"""
SELECT o_orderkey, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS epsg
FROM {ly.LONLAT_POINTS} t""")
def g4(spark, sf_dir):
    return ly.lonlat_points(spark, sf_dir).df.select("o_orderkey", crs.utm_epsg(col("lon"), col("lat")).alias("epsg"))


# --- G6-G8 -----------------------------------------------------------------------------------------


@register("g6_measures", f"""
SELECT p_partkey, round(unit * unit * CASE kind WHEN 'ell' THEN 224 WHEN 'holed' THEN 260 ELSE 324 END, 6) AS area,
  0.0::DOUBLE AS length, round(unit * CASE kind WHEN 'holed' THEN 104 ELSE 72 END, 6) AS perimeter,
  round(x0 + unit * CASE kind WHEN 'ell' THEN (144 * 10 + 80 * 5) / 224.0::DOUBLE ELSE 10 END, 6) AS x,
  round(y0 + unit * CASE kind WHEN 'ell' THEN (144 * 5 + 80 * 14) / 224.0::DOUBLE ELSE 10 END, 6) AS y
FROM {ly.PART_SHAPES} t""")
def g6(spark, sf_dir):
    return gj.measures(ly.part_shapes(spark, sf_dir)).select(
        "p_partkey", *rounded("area", "length", "perimeter", "x", "y"))


@register("g6_line_measures", f"""
SELECT event_id, round(sqrt((x2 - x) ** 2 + (y2 - y) ** 2), 6) AS length, round((x + x2) / 2, 6) AS x,
  round((y + y2) / 2, 6) AS y FROM {EVENT_LINES} t""")
def g6_lines(spark, sf_dir):
    return gj.measures(event_lines(spark, sf_dir)).select("event_id", *rounded("length", "x", "y"))


@register("g7_point_on_surface", "SELECT p_partkey, true AS inside FROM part WHERE p_size > 0")
def g7(spark, sf_dir):
    layer = ly.part_shapes(spark, sf_dir)
    placed = as_points(layer).df
    placed = once(placed, "_e", geo.edges(col("geom")))
    at = ("_px", "_py", "_e")
    return placed.where("p_size > 0").selectExpr(
        "p_partkey", f"{odd_crossings(*at)} AND NOT {on_any_edge(*at)} AS inside")


@register("g8_accessors", f"""
SELECT p_partkey, CASE kind WHEN 'ell' THEN 7 WHEN 'holed' THEN 10 ELSE 5 END AS n_points, 1 AS n_geometries,
  'POLYGON' AS kind, round(x0 + unit, 6) AS start_x, round(y0 + unit, 6) AS end_y, round(x0 + 19 * unit, 6) AS second_x,
  CASE kind WHEN 'ell' THEN 7 ELSE 5 END AS shell_points, round(324 * unit * unit, 6) AS envelope_area
FROM {ly.PART_SHAPES} t""")
def g8(spark, sf_dir):
    g = col("geom")
    last = F.when(col("kind") == "holed", geo.point_n(g, 5)).otherwise(geo.end_point(g))
    return ly.part_shapes(spark, sf_dir).df.select(
        "p_partkey", geo.num_points(g).alias("n_points"), geo.num_geometries(g).alias("n_geometries"),
        geo.geometry_type(geo.geometry_n(g, 1)).alias("kind"), F.round(geo.start_point(g)["x"], 6).alias("start_x"),
        F.round(last["y"], 6).alias("end_y"), F.round(geo.point_n(g, 2)["x"], 6).alias("second_x"),
        geo.num_points(geo.exterior_ring(g)).alias("shell_points"),
        F.round(geo.area(geo.envelope(g)), 6).alias("envelope_area"))


# --- G10-G13 ---------------------------------------------------------------------------------------


@register("g10_convex_hull", f"""
SELECT p_partkey, round(unit * unit * CASE kind WHEN 'ell' THEN 274 ELSE 324 END, 6) AS hull_area,
  CASE kind WHEN 'ell' THEN 6 ELSE 5 END AS hull_points FROM {ly.PART_SHAPES} t""")
def g10(spark, sf_dir):
    hulls = gj.hulls(ly.part_shapes(spark, sf_dir)).df
    return hulls.select("p_partkey", F.round(geo.area(col("hull")), 6).alias("hull_area"),
                        geo.num_points(col("hull")).alias("hull_points"))


@register("g11_tolerance", """
SELECT s_suppkey, round(radius * (1 - cos(pi() / 20)), 9) AS round_cap, round(2 * radius * (1 - cos(pi() / 20)), 9) AS flat_cap,
  round(radius * (1 - cos(pi() / 20)) / 111000, 12) AS degrees, round(least(greatest(0.5, radius * 0.01), radius * 0.05), 9)
  AS clamped FROM (SELECT s_suppkey, (5 + s_nationkey % 20)::DOUBLE AS radius FROM supplier)""")
def g11_tolerance(spark, sf_dir):
    r = col("radius")
    return ly.supplier_points(spark, sf_dir).df.select(
        "s_suppkey", F.round(gj.buffer_tolerance(r), 9).alias("round_cap"),
        F.round(gj.buffer_tolerance(r, flat=True), 9).alias("flat_cap"),
        F.round(gj.buffer_tolerance(r, crs="EPSG:4326"), 12).alias("degrees"),
        F.round(gj.clamped_tolerance(r), 9).alias("clamped"))


def _dense_shapes(spark, sf_dir) -> Layer:
    """Part shapes with the middle of every edge as a further vertex."""
    layer = ly.part_shapes(spark, sf_dir).where("p_size > 0")

    def densify(r):
        steps = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.array(
            a, F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))))
        return F.concat(F.flatten(steps), F.slice(r, -1, 1))

    g = col("geom")
    parts = F.transform(g["parts"], lambda part: F.transform(part, densify))
    return layer.with_df(layer.df.withColumn("geom", F.struct(g["type"].alias("type"), parts.alias("parts"))))


@register("g11_simplify", f"""
SELECT p_partkey, 2 * edges + rings AS vertices_before, edges + rings AS vertices_after,
  round(unit * unit * CASE kind WHEN 'ell' THEN 224 WHEN 'holed' THEN 260 ELSE 324 END, 6) AS area FROM (
  SELECT *, CASE kind WHEN 'ell' THEN 6 WHEN 'holed' THEN 8 ELSE 4 END AS edges,
    CASE kind WHEN 'holed' THEN 2 ELSE 1 END AS rings FROM {ly.PART_SHAPES} s) t WHERE p_size > 0""")
def g11(spark, sf_dir):
    thin = gj.simplify(_dense_shapes(spark, sf_dir), 0.001)
    return thin.select("p_partkey", "vertices_before", "vertices_after", F.round(geo.area(col("geom")), 6).alias("area"))


@register("g12_buffer_points", f"""
SELECT s_suppkey, CAST(i AS INTEGER) AS i, round(x + radius * cos((i % 20) * 2 * pi() / 20), 6) + 0.0 AS bx,
  round(y + radius * sin((i % 20) * 2 * pi() / 20), 6) + 0.0 AS by_ FROM {ly.SUPPLIER_POINTS} t,
  unnest(generate_series(0, 20)) AS u(i)""")
def g12(spark, sf_dir):
    rings = gj.buffer_points(ly.supplier_points(spark, sf_dir), "radius", 5).df
    v = rings.select("s_suppkey", F.posexplode(geo.vertices(col("geom"))).alias("i", "p"))
    return v.select("s_suppkey", "i", (F.round(col("p")["x"], 6) + 0.0).alias("bx"),
                    (F.round(col("p")["y"], 6) + 0.0).alias("by_"))


@register("g13_explode_parts", f"""
SELECT p_partkey, part, 'POLYGON' AS kind, round(x0 + CASE part WHEN 2 THEN 100 ELSE 0 END + unit, 6) AS xmin
FROM {ly.PART_SHAPES} t, unnest([1, 2]) AS u(part)""")
def g13(spark, sf_dir):
    """Each shape and a copy 100 units to the right as a multi-polygon, taken apart again."""
    layer = ly.part_shapes(spark, sf_dir)
    copy = F.transform(col("geom")["parts"], lambda part: F.transform(part, lambda r: F.transform(
        r, lambda p: F.struct((p["x"] + 100).alias("x"), p["y"].alias("y")))))
    multi = F.struct(F.lit("MULTIPOLYGON").alias("type"), F.concat(col("geom")["parts"], copy).alias("parts"))
    doubled = Layer(layer.df.withColumn("geom", multi), layer.pk, ShapeColumn(), layer.crs)
    parts = gj.explode_parts(doubled, polygons_only=True)
    return parts.select("p_partkey", "part", geo.geometry_type(col("geom")).alias("kind"),
                        F.round(geo.bbox(col("geom"))[0], 6).alias("xmin"))
