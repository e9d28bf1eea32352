"""Layers derived from the given tables, each as a Spark frame and as the same thing in SQL.

The tables hold no geometry, so positions come from their keys by plain arithmetic, in a plane of
1000 x 1000 with one decimal: boundary hits do occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosieve.layer import BoxColumns, Layer, PointColumns, ShapeColumn

PLANE = "EPSG:3857"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- points ----------------------------------------------------------------------------------------


def order_points(spark, sf_dir) -> Layer:
    df = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    df = df.withColumns({"x": ((key * 7919 + cust * 31) % 10000) / 10, "y": ((cust * 104729 + key * 17) % 10000) / 10})
    return Layer(df, ("o_orderkey",), PointColumns(), PLANE, "order_pts")


ORDER_POINTS = """(SELECT *, ((o_orderkey * 7919 + o_custkey * 31) % 10000) / 10.0::DOUBLE AS x,
    ((o_custkey * 104729 + o_orderkey * 17) % 10000) / 10.0::DOUBLE AS y FROM orders)"""


def line_points(spark, sf_dir) -> Layer:
    df = table(spark, sf_dir, "lineitem")
    c = F.col
    df = df.withColumns({
        "x": ((c("l_orderkey") * 7919 + c("l_linenumber") * 613) % 10000) / 10,
        "y": ((c("l_partkey") * 911 + c("l_suppkey") * 71) % 10000) / 10,
    })
    return Layer(df, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), PointColumns(), PLANE, "line_pts")


LINE_POINTS = """(SELECT *, ((l_orderkey * 7919 + l_linenumber * 613) % 10000) / 10.0::DOUBLE AS x,
    ((l_partkey * 911 + l_suppkey * 71) % 10000) / 10.0::DOUBLE AS y FROM lineitem)"""


def event_points(df: DataFrame) -> Layer:
    c = F.col
    df = df.withColumns({
        "x": ((c("event_id") * 613) % 10000) / 10,
        "y": ((c("event_id") * 911 + c("user_id") * 71) % 10000) / 10,
    })
    return Layer(df, ("event_id",), PointColumns(), PLANE, "event_pts")


EVENT_POINTS = """(SELECT *, ((event_id * 613) % 10000) / 10.0::DOUBLE AS x,
    ((event_id * 911 + user_id * 71) % 10000) / 10.0::DOUBLE AS y FROM events)"""


def supplier_points(spark, sf_dir) -> Layer:
    df = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    df = df.withColumns({
        "x": ((key * 613) % 1000).cast("double"),
        "y": ((key * 911) % 1000).cast("double"),
        "radius": (F.lit(5) + F.col("s_nationkey") % 20).cast("double"),
    })
    return Layer(df, ("s_suppkey",), PointColumns(), PLANE, "sup_pts")


SUPPLIER_POINTS = """(SELECT *, ((s_suppkey * 613) % 1000)::DOUBLE AS x, ((s_suppkey * 911) % 1000)::DOUBLE AS y,
    (5 + s_nationkey % 20)::DOUBLE AS radius FROM supplier)"""


def lonlat_points(spark, sf_dir) -> Layer:
    points = order_points(spark, sf_dir)
    df = points.df.withColumns({"lon": F.col("x") * 0.36 - 180, "lat": F.col("y") * 0.16 - 80})
    return Layer(df, points.pk, PointColumns("lon", "lat"), "EPSG:4326", "lonlat")


LONLAT_POINTS = f"(SELECT *, x * 0.36::DOUBLE - 180 AS lon, y * 0.16::DOUBLE - 80 AS lat FROM {ORDER_POINTS} p)"


# --- boxes and polygons ------------------------------------------------------------------------------


def part_boxes(spark, sf_dir) -> Layer:
    df = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    cx, cy = (key * 613) % 1000, (key * 911) % 1000
    df = df.withColumns({
        "xmin": cx - size / 2, "xmax": cx + size / 2,
        "ymin": (cy - (size % 7 + 1)).cast("double"), "ymax": (cy + (size % 7 + 1)).cast("double"),
    })
    return Layer(df, ("p_partkey",), BoxColumns(), PLANE, "part_rects")


PART_BOXES = """(SELECT *, (p_partkey * 613) % 1000 - p_size / 2.0::DOUBLE AS xmin,
    (p_partkey * 613) % 1000 + p_size / 2.0::DOUBLE AS xmax,
    ((p_partkey * 911) % 1000 - (p_size % 7 + 1))::DOUBLE AS ymin,
    ((p_partkey * 911) % 1000 + (p_size % 7 + 1))::DOUBLE AS ymax FROM part)"""


# corners of the zone shapes, ring by ring, in units from the origin
CORNERS = {
    "square": [[(1, 1), (19, 1), (19, 19), (1, 19), (1, 1)]],
    "holed": [[(1, 1), (19, 1), (19, 19), (1, 19), (1, 1)], [(6, 6), (6, 14), (14, 14), (14, 6), (6, 6)]],
    "ell": [[(1, 1), (19, 1), (19, 9), (9, 9), (9, 19), (1, 19), (1, 1)]],
}


def zone_shape(kind: Column, x0: Column, y0: Column, unit: Column) -> Column:
    """A square of 18 units, the same with a hole, or a concave L; origin and unit are columns."""
    corner = lambda xy: F.struct(F.lit(float(xy[0])).alias("x"), F.lit(float(xy[1])).alias("y"))
    fixed = {k: F.array(*[F.array(*map(corner, r)) for r in v]) for k, v in CORNERS.items()}
    rings = F.when(kind == "ell", fixed["ell"]).when(kind == "holed", fixed["holed"]).otherwise(fixed["square"])
    placed = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(
        (x0 + p["x"] * unit).alias("x"), (y0 + p["y"] * unit).alias("y"))))
    return F.struct(F.lit("POLYGON").alias("type"), F.array(placed).alias("parts"))


def zones(spark, sf_dir) -> Layer:
    key = F.col("n_nationkey")
    kind = F.when(key % 2 == 1, "ell").when(key % 6 == 0, "holed").otherwise("square")
    df = table(spark, sf_dir, "nation").withColumn("kind", kind).withColumns({
        "x0": ((key % 5) * 200).cast("double"), "y0": (F.floor(key / 5) * 200).cast("double")})
    df = df.withColumn("geom", zone_shape(F.col("kind"), F.col("x0"), F.col("y0"), F.lit(10.0)))
    return Layer(df, ("n_nationkey",), ShapeColumn(), PLANE, "zones")


ZONES = """(SELECT *, CASE WHEN n_nationkey % 2 = 1 THEN 'ell' WHEN n_nationkey % 6 = 0 THEN 'holed'
    ELSE 'square' END AS kind, ((n_nationkey % 5) * 200)::DOUBLE AS x0, ((n_nationkey // 5) * 200)::DOUBLE AS y0,
    10.0::DOUBLE AS unit FROM nation)"""


def part_shapes(spark, sf_dir) -> Layer:
    """A polygon per part: square, holed square or L of up to 50 units."""
    df = table(spark, sf_dir, "part")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)  # a small file is few tasks, and shapes are dear to build
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 1, "ell").when(key % 3 == 2, "holed").otherwise("square")
    df = df.withColumns({"kind": kind, "x0": ((key * 613) % 1000).cast("double"),
                         "y0": ((key * 911) % 1000).cast("double"), "unit": F.col("p_size") / 20})
    df = df.withColumn("geom", zone_shape(F.col("kind"), F.col("x0"), F.col("y0"), F.col("unit")))
    return Layer(df, ("p_partkey",), ShapeColumn(), PLANE, "part_shapes")


PART_SHAPES = """(SELECT *, CASE WHEN p_partkey % 3 = 1 THEN 'ell' WHEN p_partkey % 3 = 2 THEN 'holed'
    ELSE 'square' END AS kind, ((p_partkey * 613) % 1000)::DOUBLE AS x0, ((p_partkey * 911) % 1000)::DOUBLE AS y0,
    p_size / 20.0::DOUBLE AS unit FROM part)"""


def in_zone(x: str, y: str, zone: str, closed: bool = True) -> str:
    """SQL for a point in a zone shape, with or without its border."""
    le, lt = ("<=", "<") if closed else ("<", "<=")

    def box(a, b, c, d, op):
        return (f"({zone}.x0 + {a} * {zone}.unit {op} {x} AND {x} {op} {zone}.x0 + {c} * {zone}.unit AND "
                f"{zone}.y0 + {b} * {zone}.unit {op} {y} AND {y} {op} {zone}.y0 + {d} * {zone}.unit)")

    square = box(1, 1, 19, 19, le)
    holed = f"({square} AND NOT {box(6, 6, 14, 14, lt)})"
    # the two arms of the L meet inside it, so the open L is the square without the closed notch
    notch = (f"({x} {'>' if closed else '>='} {zone}.x0 + 9 * {zone}.unit AND "
             f"{y} {'>' if closed else '>='} {zone}.y0 + 9 * {zone}.unit)")
    return (f"CASE {zone}.kind WHEN 'holed' THEN {holed} WHEN 'ell' THEN {square} AND NOT {notch} "
            f"ELSE {square} END")
