"""Spark-native feature filtering: attribute, spatial and raster filters over very large layers."""

from geosieve.layer import BoxColumns, Layer, PointColumns, ShapeColumn

__all__ = ["BoxColumns", "Layer", "PointColumns", "ShapeColumn"]
