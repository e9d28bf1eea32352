"""Layers from files and databases, projected scans, batch-wise work on rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosieve.functions.expressions import as_column
from geosieve.functions.wkb import from_wkb
from geosieve.layer import Layer, PointColumns, ShapeColumn, once
from geosieve.operators.geometry_jobs import ingest_wkt

# Provider names and the Spark format that reads them.
FORMATS = {
    "parquet": "parquet",
    "geoparquet": "parquet",
    "orc": "orc",
    "json": "json",
    "csv": "csv",
    "delimitedtext": "csv",
    "postgres": "jdbc",
    "mssql": "jdbc",
    "oracle": "jdbc",
    "hana": "jdbc",
    "jdbc": "jdbc",
}


def read_table(spark: SparkSession, provider: str, path: str | None = None, schema=None, **options) -> DataFrame:
    """A frame of a provider; databases take ``url`` and ``dbtable`` (and the partitioning options) of JDBC."""
    if provider not in FORMATS:
        raise ValueError(f"no reader for provider {provider!r}")
    fmt = FORMATS[provider]
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def read_layer(spark: SparkSession, provider: str, path: str | None = None, pk: Sequence[str] = ("id",),
               wkt: str | None = None, wkb: str | None = None, xy: tuple[str, str] | None = None, crs: str = "EPSG:3857", name: str = "",
               schema=None, **options) -> Layer:
    """A layer whose geometry is a struct column, a WKT text, WKB bytes, two coordinates, or absent.

    ``geoparquet`` takes the column ``geometry`` for WKB, as such files name it; its CRS is the caller's to say.
    """
    df = read_table(spark, provider, path, schema, **options)
    if provider == "geoparquet" and not (wkb or wkt or xy):
        wkb = "geometry"
    if wkb:
        return Layer(once(df, "geom", from_wkb(F.col(wkb))).drop(wkb), pk, ShapeColumn("geom"), crs, name)
    if wkt:
        return Layer(ingest_wkt(df, wkt)[0].drop(wkt), pk, ShapeColumn("geom"), crs, name)
    if xy:
        return Layer(df, pk, PointColumns(*xy), crs, name)
    return Layer(df, pk, ShapeColumn("geom") if "geom" in df.columns else None, crs, name)


def scan(layer: Layer, expr: Column | str | None = None, fields: Sequence[str] | None = None,
         limit: int | None = None, geometry: bool = True, order_by: Sequence[str] | None = None) -> DataFrame:
    """Filtered, projected and optionally limited rows; the geometry can be left out."""
    df = layer.df if expr is None else layer.df.where(as_column(expr))
    geometry_columns = layer.geometry.columns if layer.geometry else []
    columns = list(fields) if fields is not None else [c for c in df.columns if c not in geometry_columns]
    if geometry:
        columns += [c for c in geometry_columns if c not in columns]
    if order_by:
        df = df.orderBy(*order_by)
    df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_rows: int = 5000
                ) -> DataFrame:
    """Applies ``f`` to batches of at most ``batch_rows`` rows, inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                yield f(frame.iloc[start : start + batch_rows])

    return df.mapInPandas(run, schema)
