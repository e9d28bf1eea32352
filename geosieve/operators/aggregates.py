"""Value lists, extents, counts and grouped aggregates of layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosieve.functions.expressions import as_column
from geosieve.layer import SHAPE_DDL, BoxColumns, Layer
from geosieve.operators.windows import bucketed_rank
from geosieve.sizing import sized_join

# Padding of an extent.
POINT_PAD = 50.0
PAD_SHARE = 0.1
LEAST_PAD = 5.0
EMPTY_PAD = 10.0

CHUNK_ROWS = 10_000


def unique_values(df: DataFrame, field: str) -> DataFrame:
    """Distinct values of a field as text, without NULL, sorted."""
    text = F.col(field).cast("string").alias("value")
    return df.select(text).dropna().distinct().orderBy("value")


def display_list(layer: Layer, display: Column | str, order: str = "ASC", subset: DataFrame | None = None,
                 strategy: str = "auto") -> DataFrame:
    """(key, display, in_subset), rows of the subset first, then by display and key."""
    df = layer.df.select(*layer.pk, as_column(display).cast("string").alias("display"))
    if subset is None:
        df = df.withColumn("in_subset", F.lit(True))
    else:
        keys = subset.select(*layer.pk).distinct().withColumn("in_subset", F.lit(True))
        df = sized_join(df, keys, layer.pk, "left", layer.pk, strategy)
        df = df.withColumn("in_subset", F.coalesce("in_subset", F.lit(False)))
    by = F.col("display").asc() if order.upper() == "ASC" else F.col("display").desc()
    return df.select(*layer.pk, "display", "in_subset").orderBy(F.col("in_subset").desc(), by, *layer.pk)


def search(df: DataFrame, text: str, column: str = "display") -> DataFrame:
    """Rows whose text contains the given one, whatever the case."""
    return df.where(F.contains(F.lower(F.col(column)), F.lit(text.lower())))


def extent(layer: Layer) -> DataFrame:
    x0, y0, x1, y1 = layer.geometry.bbox()
    return layer.df.where(layer.geometry.present()).agg(
        F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"), F.max(y1).alias("ymax"))


def pad_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, point: bool) -> dict[str, Column]:
    """A point grows by 50, a box by the larger of a tenth of its sides and 5, an empty box by 10."""
    w, h = xmax - xmin, ymax - ymin
    grow = F.lit(POINT_PAD) if point else F.when((w <= 0) | (h <= 0), F.lit(EMPTY_PAD)).otherwise(
        F.greatest(w * PAD_SHARE, h * PAD_SHARE, F.lit(LEAST_PAD)))
    return {"xmin": xmin - grow, "ymin": ymin - grow, "xmax": xmax + grow, "ymax": ymax + grow}


def padded_extents(layer: Layer) -> DataFrame:
    """Per feature: the box to zoom to."""
    box = pad_box(*layer.geometry.bbox(), point=layer.geometry.kind == "point")
    return layer.df.where(layer.geometry.present()).select(*layer.pk, *[c.alias(n) for n, c in box.items()])


def padded_extent(layer: Layer) -> DataFrame:
    """The box to zoom to for all features together."""
    box = padded_extents(layer)
    return box.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"),
                   F.max("ymax").alias("ymax"))


def count(layer: Layer, distinct: str | None = None, estimate: bool = False) -> DataFrame:
    """Number of rows, or of distinct values of a column (estimated where asked)."""
    if distinct is None:
        return layer.df.agg(F.count("*").alias("n"))
    f = F.approx_count_distinct if estimate else F.count_distinct
    return layer.df.agg(f(F.col(distinct)).alias("n"))


def display_aggregates(df: DataFrame, by: Sequence[str], value: Column | str) -> DataFrame:
    """SUM, COUNT, AVG, MIN and MAX of an expression per group."""
    v = as_column(value)
    return df.groupBy(*by).agg(F.sum(v).alias("sum_value"), F.count(v).alias("count_value"),
                               F.avg(v).alias("avg_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def array_agg(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """ARRAY_AGG in chunks: (group, chunk, values), values in order and whole.

    A group of any size is an ordered list of arrays of ``chunk_rows`` values, so that no task and no
    row holds an unbounded group. ``bucket`` follows the order (see ``bucketed_rank``).
    """
    ranked = bucketed_rank(df, by, order, bucket, "_rank")
    ranked = ranked.withColumn("chunk", F.floor((F.col("_rank") - 1) / chunk_rows))
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v"))))
    return ranked.groupBy(*by, "chunk").agg(listed.alias("_l")).select(
        *by, "chunk", F.transform("_l", lambda e: e["v"]).alias("values"))


def top_counts(df: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(k)


# --- geometry aggregates ----------------------------------------------------------------------------


def collect_geometries(layer: Layer, by: Sequence[str], bucket: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Multi-geometries per group, in chunks like ``array_agg``: (group, chunk, geom)."""
    shaped = layer.as_shapes("_shape").df.where(layer.geometry.present())
    ranked = bucketed_rank(shaped, by, list(layer.pk), bucket, "_rank")
    ranked = ranked.withColumn("chunk", F.floor((F.col("_rank") - 1) / chunk_rows))
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.col("_shape")["parts"].alias("parts"))))
    kind = F.regexp_replace(F.min(F.col("_shape")["type"]), "^(MULTI)?", "MULTI")
    return ranked.groupBy(*by, "chunk").agg(listed.alias("_l"), kind.alias("_k")).select(
        *by, "chunk",
        F.struct(F.col("_k").alias("type"), F.flatten(F.transform("_l", lambda e: e["parts"])).alias("parts"))
        .cast(SHAPE_DDL).alias("geom"))


def dissolve_boxes(layer: Layer, by: Sequence[str], cell: float) -> DataFrame:
    """Union of grid-aligned boxes per group: covered area, cells and bounding box, overlaps counted once.

    A box gives one interval of rows per grid column; intervals of a column are merged with a running maximum, so cells
    are counted and never made. A box whose sides are not on the grid is an error. Copies of a box are dropped before
    the shuffle.
    """
    if not isinstance(layer.geometry, BoxColumns):
        raise ValueError("dissolve_boxes works on box layers")
    x0, y0, x1, y1 = layer.geometry.bbox()
    at = lambda v: F.round(v / cell).cast("long")
    rows = layer.df.where(layer.geometry.present() & (x1 > x0) & (y1 > y0))
    off = reduce(lambda a, b: a | b, [F.abs(v / cell - F.round(v / cell)) > 1e-9 for v in (x0, y0, x1, y1)])
    checked = F.when(off, F.raise_error(F.lit(f"a box is not aligned to the grid of {cell}")).cast("long"))
    first = F.coalesce(checked, at(x0))
    columns = rows.select(*by, F.explode(F.sequence(first, at(x1) - 1)).alias("cx"), at(y0).alias("_y0"),
                          (at(y1) - 1).alias("_y1")).distinct()
    before = Window.partitionBy(*by, "cx").orderBy("_y0", "_y1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("_y1") - F.greatest("_y0", F.coalesce(F.max("_y1").over(before) + 1, "_y0")) + 1
    cells = columns.withColumn("_n", F.greatest(fresh, F.lit(0)))
    return cells.groupBy(*by).agg(
        F.sum("_n").alias("n_cells"), (F.sum("_n") * (cell * cell)).alias("area"),
        (F.min("cx") * cell).alias("xmin"), (F.min("_y0") * cell).alias("ymin"),
        ((F.max("cx") + 1) * cell).alias("xmax"), ((F.max("_y1") + 1) * cell).alias("ymax"))
