"""Export: one layer, many layers, one container for many layers; GeoJSON lines and CSV with WKT."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosieve.functions import geometry as geo
from geosieve.functions.crs import reproject
from geosieve.layer import Layer

# Bytes a feature takes, apart from its vertices, and bytes per vertex.
FEATURE_BYTES = 700
VERTEX_BYTES = 16
FORMATS = ("parquet", "orc", "json", "csv", "geojson")


def safe_name(name: str) -> str:
    """A file name without characters that file systems refuse."""
    return re.sub(r'[<>:"/\\|?*]', "_", re.sub("[–—]", "-", name))


def geojson_geometry(geom: Column) -> Column:
    """GeoJSON text of a geometry struct."""
    # Names of the types.
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint",
             "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}

    def wrap(items):
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    def vertex(p):
        return F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))

    flat = F.transform(geo.vertices(geom), vertex)
    rings = F.transform(geo.rings(geom), lambda r: wrap(F.transform(r, vertex)))
    parts = F.transform(geom["parts"], lambda part: wrap(F.transform(part, lambda r: wrap(F.transform(r, vertex)))))
    kind = geom["type"]
    body = F.when(kind == "POINT", flat[0]).when(kind.isin("LINESTRING", "MULTIPOINT"), wrap(flat)).when(
        kind.isin("POLYGON", "MULTILINESTRING"), wrap(rings)).otherwise(wrap(parts))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), kind)
    return F.coalesce(F.concat(F.lit('{"type":"'), label, F.lit('","coordinates":'), body, F.lit("}")), F.lit("null"))


def geojson_lines(layer: Layer) -> DataFrame:
    """One text column, one GeoJSON feature per row."""
    fields = [c for c in layer.df.columns if c not in layer.geometry.columns]
    properties = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return layer.df.select(F.concat(
        F.lit('{"type":"Feature","geometry":'), geojson_geometry(layer.geometry.shape()),
        F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def export_frame(layer: Layer, crs: str | None = None, rename: dict[str, str] | None = None,
                 fmt: str = "parquet") -> DataFrame:
    """What is written for a layer: reprojected, fields renamed, geometry as the format wants it."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if crs:
        layer = reproject(layer, crs)
    if rename:
        layer = Layer(layer.df.withColumnsRenamed({a: b for a, b in rename.items() if a not in layer.geometry.columns}),
                      [rename.get(k, k) for k in layer.pk], layer.geometry, layer.crs, layer.name)
    if fmt == "geojson":
        return geojson_lines(layer)
    if fmt == "csv":
        wkt = geo.to_wkt(layer.geometry.shape(), geo.wkt_decimals(layer.crs))
        rest = [c for c in layer.df.columns if c not in layer.geometry.columns]
        flat = [f.name for f in layer.df.select(*rest).schema if not isinstance(
            f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        nested = [F.to_json(c).alias(c) for c in rest if c not in flat]
        return layer.df.select(*flat, *nested, wkt.alias("wkt"))
    return layer.df


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    writer = df.write.mode(mode)
    if fmt == "geojson":
        writer.text(path)
    elif fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)


def export(layer: Layer, path: str, fmt: str = "parquet", crs: str | None = None,
           rename: dict[str, str] | None = None, mode: str = "errorifexists") -> int:
    """Writes the layer and returns its number of rows, observed while writing."""
    seen = Observation()
    df = layer.with_df(layer.df.observe(seen, F.count("*").alias("n")))
    _write(export_frame(df, crs, rename, fmt), path, fmt, mode)
    return seen.get["n"]


def export_many(layers: dict[str, Layer], folder: str, fmt: str = "parquet", crs: str | None = None,
                mode: str = "errorifexists") -> DataFrame:
    """Writes each layer to its own folder: (layer, path, rows, ok, error); a failure does not stop the rest."""
    done, spark = [], None
    for name, layer in layers.items():
        spark = layer.df.sparkSession
        path = f"{folder}/{safe_name(name)}"
        try:
            done.append((name, path, export(layer, path, fmt, crs, mode=mode), True, None))
        except Exception as e:  # noqa: BLE001
            done.append((name, path, 0, False, str(e).splitlines()[0]))
    if spark is None:
        raise ValueError("no layers to export")
    return spark.createDataFrame(done, "layer string, path string, rows long, ok boolean, error string")


def export_summary(layers: dict[str, Layer]) -> DataFrame:
    """What an export of these layers would write: (layer, file, rows, bytes)."""
    frames = [export_estimate(layer).select(F.lit(name).alias("layer"), F.lit(safe_name(name)).alias("file"),
                                            "rows", "bytes") for name, layer in layers.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def package(layers: dict[str, Layer]) -> DataFrame:
    """All layers in one frame with a ``layer`` column; fields a layer lacks are NULL."""
    out = None
    for name, layer in layers.items():
        df = layer.df.withColumn("layer", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def export_package(layers: dict[str, Layer], path: str, mode: str = "errorifexists") -> None:
    package(layers).write.mode(mode).partitionBy("layer").parquet(path)


def export_estimate(layer: Layer) -> DataFrame:
    """Rows and estimated bytes of an export."""
    return layer.df.agg(F.count("*").alias("rows"), F.sum(
        F.lit(FEATURE_BYTES) + VERTEX_BYTES * layer.geometry.n_vertices()).cast("long").alias("bytes"))
