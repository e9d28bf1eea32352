"""A layer: a lazy DataFrame plus its key, its geometry encoding and its CRS.

Geometry is kept in ordinary columns, so that pruning, pushdown and codegen keep working:

* ``PointColumns``  two double columns (cheapest; use it for large point tables)
* ``BoxColumns``    four double columns holding an axis-aligned rectangle
* ``ShapeColumn``   ``struct<type: string, parts: array<array<array<struct<x, y>>>>>``
  (part -> ring -> vertex) for lines, polygons and multi-geometries
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE_DDL = "struct<type: string, parts: array<array<array<struct<x: double, y: double>>>>>"


@dataclass(frozen=True)
class PointColumns:
    x: str = "x"
    y: str = "y"
    kind = "point"

    @property
    def columns(self) -> list[str]:
        return [self.x, self.y]

    def bbox(self) -> tuple[Column, Column, Column, Column]:
        x, y = F.col(self.x), F.col(self.y)
        return x, y, x, y

    def present(self) -> Column:
        return finite(F.col(self.x)) & finite(F.col(self.y))

    def n_vertices(self) -> Column:
        return F.when(self.present(), F.lit(1)).otherwise(F.lit(0))

    def shape(self) -> Column:
        point = F.struct(F.col(self.x).cast("double").alias("x"), F.col(self.y).cast("double").alias("y"))
        return F.when(
            self.present(), F.struct(F.lit("POINT").alias("type"), F.array(F.array(F.array(point))).alias("parts"))
        )


@dataclass(frozen=True)
class BoxColumns:
    xmin: str = "xmin"
    ymin: str = "ymin"
    xmax: str = "xmax"
    ymax: str = "ymax"
    kind = "box"

    @property
    def columns(self) -> list[str]:
        return [self.xmin, self.ymin, self.xmax, self.ymax]

    def bbox(self) -> tuple[Column, Column, Column, Column]:
        return F.col(self.xmin), F.col(self.ymin), F.col(self.xmax), F.col(self.ymax)

    def present(self) -> Column:
        xmin, ymin, xmax, ymax = self.bbox()
        return finite(xmin) & finite(ymin) & finite(xmax) & finite(ymax) & (xmin <= xmax) & (ymin <= ymax)

    def n_vertices(self) -> Column:
        return F.when(self.present(), F.lit(5)).otherwise(F.lit(0))

    def shape(self) -> Column:
        xmin, ymin, xmax, ymax = (c.cast("double") for c in self.bbox())
        corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        ring = F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax),
                       corner(xmin, ymin))
        return F.when(
            self.present(), F.struct(F.lit("POLYGON").alias("type"), F.array(F.array(ring)).alias("parts"))
        )


@dataclass(frozen=True)
class ShapeColumn:
    name: str = "geom"
    kind = "shape"

    @property
    def columns(self) -> list[str]:
        return [self.name]

    def vertices(self) -> Column:
        return F.flatten(F.flatten(F.col(self.name)["parts"]))

    def bbox(self) -> tuple[Column, Column, Column, Column]:
        v = self.vertices()
        return F.array_min(v["x"]), F.array_min(v["y"]), F.array_max(v["x"]), F.array_max(v["y"])

    def present(self) -> Column:
        v = self.vertices()
        return F.coalesce(
            (F.size(v) > 0) & F.forall(v, lambda p: finite(p["x"]) & finite(p["y"])), F.lit(False))

    def n_vertices(self) -> Column:
        return F.coalesce(F.size(self.vertices()), F.lit(0))

    def shape(self) -> Column:
        return F.col(self.name)


Geometry = PointColumns | BoxColumns | ShapeColumn


def finite(c: Column) -> Column:
    """True for an ordinary number, false for NULL, NaN and the infinities."""
    return F.coalesce(c - c == 0, F.lit(False))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row.

    A plain projected expression is copied into every filter and column that uses it; a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


@dataclass(frozen=True)
class Layer:
    df: DataFrame
    pk: Sequence[str] = ("id",)
    geometry: Geometry | None = field(default_factory=ShapeColumn)
    crs: str = "EPSG:3857"
    name: str = ""

    def __post_init__(self):
        keys = (self.pk,) if isinstance(self.pk, str) else tuple(self.pk)
        object.__setattr__(self, "pk", keys)
        needed = set(keys) | set(self.geometry.columns if self.geometry else ())
        missing = sorted(needed - set(self.df.columns))
        if missing:
            raise ValueError(f"layer {self.name or '?'}: no column {', '.join(missing)}")

    def where(self, condition: Column | str) -> Layer:
        return replace(self, df=self.df.where(condition))

    def with_df(self, df: DataFrame) -> Layer:
        return replace(self, df=df)

    def keys(self) -> DataFrame:
        return self.df.select(*self.pk)

    def as_shapes(self, column: str = "geom") -> Layer:
        """The same rows with the general geometry struct in ``column``."""
        df = self.df.withColumn(column, self.geometry.shape())
        return replace(self, df=df, geometry=ShapeColumn(column))
