"""Whole-table geometry jobs: ingest, checks, repair, parts, buffers, hulls, simplification."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.functions import geometry as geo
from geosieve.functions.crs import METRES_PER_DEGREE, is_geographic
from geosieve.functions.relate import hull_coordinates, hull_shape, kept_vertices, thinned
from geosieve.layer import SHAPE_DDL, Layer, ShapeColumn, once


def ingest_wkt(df: DataFrame, wkt: str, geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """(rows with a geometry, rows whose text is not readable); a NULL text is a NULL geometry."""
    read = once(df, geom, geo.from_wkt(F.col(wkt)))
    bad = F.col(geom).isNull() & F.col(wkt).isNotNull()
    return read.where(~bad), read.where(bad).drop(geom)


def with_wkt(layer: Layer, name: str = "wkt") -> DataFrame:
    return layer.df.withColumn(name, geo.to_wkt(layer.geometry.shape(), geo.wkt_decimals(layer.crs)))


def check(layer: Layer, name: str = "issue") -> DataFrame:
    """The rows with what is wrong with their geometry, NULL for nothing."""
    return layer.df.withColumn(name, geo.geometry_issue(layer.geometry.shape()))


def drop_invalid(layer: Layer) -> Layer:
    return layer.where(geo.is_valid(layer.geometry.shape()))


def repair(layer: Layer) -> DataFrame:
    """A usable geometry for filtering: invalid ones become their hull, else their bounding box.

    ``repair_kind`` says which: NULL, "hull", "box" or "none" (nothing to build one from).
    """
    g = once(layer.as_shapes("_g").df, "_issue", geo.geometry_issue(F.col("_g")))
    good = F.filter(geo.vertices(F.col("_g")), lambda p: (p["x"] - p["x"] == 0) & (p["y"] - p["y"] == 0))
    cloud = F.when(F.col("_issue").isNotNull() & (F.size(good) > 0), F.struct(
        F.lit("MULTIPOINT").alias("type"), F.array(F.array(good)).alias("parts")).cast(SHAPE_DDL))
    g = once(g, "_cloud", cloud)
    g = once(g, "_flat", hull_coordinates(F.col("_cloud"))).withColumn("_hull", hull_shape(F.col("_flat")))
    is_area = F.col("_hull")["type"] == "POLYGON"
    kind = F.when(F.col("_issue").isNull(), F.lit(None)).when(is_area, "hull").when(
        F.col("_cloud").isNotNull(), "box").otherwise("none")
    fixed = F.when(F.col("_issue").isNull(), F.col("_g")).when(is_area, F.col("_hull")).otherwise(
        geo.envelope(F.col("_cloud")))
    columns = [c for c in layer.df.columns if c not in layer.geometry.columns]
    return g.select(*columns, fixed.alias("geom"), kind.cast("string").alias("repair_kind"))


def measures(layer: Layer) -> DataFrame:
    """Area, length, perimeter, and the position of the centroid."""
    g = layer.as_shapes("_g").df
    c = geo.centroid(F.col("_g"))
    return g.withColumn("_c", c).select(
        *layer.pk, geo.area(F.col("_g")).alias("area"), geo.length(F.col("_g")).alias("length"),
        geo.perimeter(F.col("_g")).alias("perimeter"), F.col("_c")["x"].alias("x"), F.col("_c")["y"].alias("y"))


def explode_parts(layer: Layer, polygons_only: bool = False) -> DataFrame:
    """Single parts of multi-geometries with their number (from 1); optionally the polygons alone."""
    g = layer.as_shapes("_g").df
    if polygons_only:
        g = g.where(F.col("_g")["type"].endswith("POLYGON"))
    columns = [c for c in layer.df.columns if c not in layer.geometry.columns]
    parts = g.select(*columns, geo.explode_type(F.col("_g")["type"]).alias("_t"),
                     F.posexplode(F.col("_g")["parts"]).alias("_i", "_part"))
    return parts.select(*columns, (F.col("_i") + 1).alias("part"), F.struct(
        F.col("_t").alias("type"), F.array("_part").alias("parts")).cast(SHAPE_DDL).alias("geom"))


def buffer_points(layer: Layer, radius: Column | float | str, segments: int = 5) -> Layer:
    """Round buffer polygons of a point layer."""
    g = layer.geometry
    if g.kind != "point":
        raise ValueError("buffer polygons are built for points; use a radius in the spatial filter for others")
    r = F.col(radius) if isinstance(radius, str) else radius
    df = layer.df.withColumn("geom", F.when(g.present(), geo.buffer_point(F.col(g.x), F.col(g.y), r, segments)))
    return Layer(df, layer.pk, ShapeColumn("geom"), layer.crs, layer.name)


def hulls(layer: Layer) -> Layer:
    flat = once(layer.as_shapes("_g").df, "_flat", hull_coordinates(F.col("_g")))
    df = flat.withColumn("hull", hull_shape(F.col("_flat"))).drop("_g", "_flat")
    return replace(layer, df=df, geometry=ShapeColumn("hull"))


def buffer_tolerance(radius: Column, segments: int = 5, flat: bool = False, extent: Column | None = None,
                     crs: str = "EPSG:3857") -> Column:
    """Tolerance that a buffer of so many segments per quarter cannot show: r (1 - cos(pi / 4n))."""
    arc = F.abs(radius) * (1 - math.cos(math.pi / (4 * segments))) * (2.0 if flat else 1.0)
    without = (extent if extent is not None else F.lit(0.0)) * 0.001
    tolerance = F.when(radius == 0, without).otherwise(arc)
    return tolerance / METRES_PER_DEGREE if is_geographic(crs) else tolerance


def clamped_tolerance(radius: Column, base: float = 0.5, crs: str = "EPSG:3857") -> Column:
    """The base tolerance, at least 1 % and at most 5 % of the buffer distance."""
    r = F.abs(radius)
    tolerance = F.when(r > 0, F.least(F.greatest(F.lit(base), r * 0.01), r * 0.05)).otherwise(F.lit(base))
    return tolerance / METRES_PER_DEGREE if is_geographic(crs) else tolerance


def simplify(layer: Layer, tolerance: Column | float) -> DataFrame:
    """Douglas-Peucker per ring, with ``vertices_before`` and ``vertices_after``.

    An empty or invalid outcome is replaced by the input.
    """
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    kept = once(layer.as_shapes("_g").df, "_kept", kept_vertices(F.col("_g"), tol.cast("double")))
    g = once(kept, "_thin", thinned(F.col("_g"), F.col("_kept")))
    result = F.when(geo.is_valid(F.col("_thin")), F.col("_thin")).otherwise(F.col("_g"))
    columns = [c for c in layer.df.columns if c not in layer.geometry.columns]
    return g.select(*columns, result.alias("geom"), geo.num_points(F.col("_g")).alias("vertices_before"),
                    geo.num_points(result).alias("vertices_after"))


def tile(layer: Layer, cell: float) -> DataFrame:
    """(key, cx, cy): the grid cells that a feature's bounding box touches."""
    x0, y0, x1, y1 = layer.geometry.bbox()
    at = lambda v: F.floor(v / F.lit(float(cell)))
    rows = layer.df.where(layer.geometry.present())
    by_column = rows.select(*layer.pk, F.explode(F.sequence(at(x0), at(x1))).alias("cx"), at(y0).alias("_y0"),
                            at(y1).alias("_y1"))
    return by_column.select(*layer.pk, "cx", F.explode(F.sequence("_y0", "_y1")).alias("cy"))


def distances(pairs: DataFrame, a: str, b: str, name: str = "distance") -> DataFrame:
    return pairs.withColumn(name, geo.distance(a, b))
