"""Raster sampling, zonal statistics and point-cloud filters.

A raster is a table of cells ``(band, col, row, value)``; NoData is a NULL value or a missing row. A sample is
an equi-join on the cell index. A zone becomes runs of cells, one or a few per raster row, found where its edges cross
the row's centre line; runs meet the raster in tiles of a row's cells, and a tile within a run counts by its totals. So
zones cost their border, not their area, wherever totals will do.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.functions import geometry as geo
from geosieve.functions.expressions import all_of, any_of, as_column, compare
from geosieve.layer import Layer
from geosieve.operators.spatial import as_points, spatial_filter
from geosieve.operators.windows import exact_median, same_keys
from geosieve.sizing import settle, sized_join

STATS = ("n", "sum", "min", "max", "mean", "std", "median")
TILE = 256  # cells of a row


@dataclass(frozen=True)
class Raster:
    """Cells with the origin of cell (0, 0) and the cell size; rows count upwards from ``y0``."""

    cells: DataFrame
    x0: float = 0.0
    y0: float = 0.0
    size: float = 1.0

    def band(self, band: int) -> DataFrame:
        if band < 1:
            raise ValueError(f"bands count from 1, got {band}")
        return self.cells.where(F.col("band") == band)

    def index(self, x: Column, y: Column) -> dict[str, Column]:
        return {"_col": F.floor((x - self.x0) / self.size), "_row": F.floor((y - self.y0) / self.size)}


def sample(layer: Layer, raster: Raster, bands: Sequence[int] = (1,), method: str = "point_on_surface",
           strategy: str = "auto") -> DataFrame:
    """The layer with ``band_<n>`` columns: the value under each feature's point, NULL on NoData or outside."""
    if any(b < 1 for b in bands):
        raise ValueError("bands count from 1")
    columns = layer.df.columns
    points = as_points(layer, method)
    x, y = F.col(points.geometry.x), F.col(points.geometry.y)
    index = {n: F.when(points.geometry.present(), c) for n, c in raster.index(x, y).items()}
    wide = raster.cells.where(F.col("band").isin(list(bands))).groupBy(
        F.col("col").cast("long").alias("_col"), F.col("row").cast("long").alias("_row")).agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"band_{b}") for b in bands])
    joined = sized_join(points.df.withColumns(index), wide, ["_col", "_row"], "left", layer.pk, strategy)
    return joined.select(*columns, *[f"band_{b}" for b in bands])


def value_filter(df: DataFrame, op: str, threshold: float, threshold_max: float | None = None,
                 column: str = "band_1") -> DataFrame:
    return df.where(compare(F.col(column), op, threshold, threshold_max))


def sampling_stats(df: DataFrame, column: str = "band_1", matching: Column | str | None = None) -> DataFrame:
    """One row: total, sampled, nodata, matching, min, max, mean, population std and exact median.

    Everything comes from the counts of equal values, so the sampled rows are read once.
    """
    test = as_column(matching) if matching is not None else F.col(column).isNotNull()
    counted = settle(df.groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("_n"), F.count_if(test).alias("_matching")).withColumn("_one", F.lit(1)))
    n, v = F.col("_n"), F.col("value")
    totals = counted.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("sampled"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nodata"),
        F.coalesce(F.sum("_matching"), F.lit(0)).alias("matching")).withColumn("_one", F.lit(1))
    values = _from_counts(counted.where(v.isNotNull()).select("_one", "value", "_n"), ["_one"])
    return totals.join(values, "_one", "left").select(
        "total", "sampled", "nodata", "matching", F.col("min").alias("min_value"), F.col("max").alias("max_value"),
        F.col("mean").alias("mean_value"), F.col("std").alias("std_value"), F.col("median").alias("median_value"))


def zone_spans(layer: Layer, raster: Raster) -> DataFrame:
    """(key, _row, _first, _last): runs of cells whose centres a feature covers, its border included; none overlap.

    Edges cross a centre line just above and just below it; what lies between the crossings of either is covered, which
    counts corners and level edges on the line. Lines and points cover the centres they pass through.
    """
    shape, pk = layer.geometry.shape(), list(layer.pk)
    u = lambda x: (x - raster.x0) / raster.size - 0.5
    v = lambda y: (y - raster.y0) / raster.size - 0.5
    edges = layer.df.where(layer.geometry.present()).select(*pk, shape.alias("_g"))
    edges = edges.select(*pk, F.col("_g")["type"].endswith("POLYGON").alias("_area"), F.explode(geo.edges(F.col("_g"))).alias("e"))
    edges = edges.select(*pk, "_area", u(F.col("e.x1")).alias("u1"), v(F.col("e.y1")).alias("v1"), u(F.col("e.x2")).alias("u2"),
                         v(F.col("e.y2")).alias("v2"))
    low, high = F.ceil(F.least("v1", "v2")), F.floor(F.greatest("v1", "v2"))
    rows = edges.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("_row"))
    rows = rows.selectExpr("*", "u1 + (_row - v1) * (u2 - u1) / nullif(v2 - v1, 0D) AS x",
                           "(v1 <= _row) <> (v2 <= _row) AS above", "(v1 < _row) <> (v2 < _row) AS below")
    crossed = rows.where("_area AND (above OR below)").groupBy(*pk, "_row").agg(
        F.sort_array(F.collect_list(F.when(F.col("above"), F.col("x")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("below"), F.col("x")))).alias("b"))

    def runs(xs: str) -> str:
        return (f"transform(filter(transform({xs}, (x, i) -> named_struct('a', x, 'b', get({xs}, i + 1), 'i', i)), "
                "s -> s.i % 2 = 0 AND s.b IS NOT NULL), s -> named_struct('first', ceil(s.a), 'last', floor(s.b)))")

    # a run begins after all that went before it
    merged = ("aggregate(array_sort(filter(if(a = b, {0}, concat({0}, {1})), s -> s.first <= s.last)), "
              "named_struct('out', cast(array() AS array<struct<first: bigint, last: bigint>>), 'end', cast(null AS bigint)), "
              "(t, s) -> named_struct('out', if(t.end IS NULL OR s.last > t.end, array_append(t.out, named_struct("
              "'first', greatest(s.first, coalesce(t.end + 1, s.first)), 'last', s.last)), t.out), "
              "'end', greatest(t.end, s.last)), t -> t.out)").format(runs("a"), runs("b"))
    areas = crossed.select(*pk, "_row", F.explode(F.expr(merged)).alias("s")).select(
        *pk, "_row", F.col("s.first").alias("_first"), F.col("s.last").alias("_last"))
    along = F.expr("if(v1 = v2, named_struct('first', ceil(least(u1, u2)), 'last', floor(greatest(u1, u2))), "
                   "if(x = floor(x), named_struct('first', floor(x), 'last', floor(x)), null))")
    lines = rows.where("NOT _area").select(*pk, "_row", along.alias("s")).where("s.first <= s.last")
    # edges of a line may share cells, but few do: cell by cell they are told apart
    lines = lines.select(*pk, "_row", F.explode(F.expr("sequence(s.first, s.last)")).alias("_first")).distinct()
    return areas.unionByName(lines.withColumn("_last", F.col("_first")))


def row_tiles(raster: Raster, band: int, width: int = TILE) -> DataFrame:
    """(_row, _tile, _cells, n, sum, min, max): the cells of ``width`` columns of a row, with their totals."""
    v = F.col("value")
    cells = raster.band(band).where(v.isNotNull())
    return cells.groupBy(F.col("row").cast("long").alias("_row"), F.floor(F.col("col") / width).alias("_tile")).agg(
        F.collect_list(F.struct(F.col("col"), v.alias("value"))).alias("_cells"), F.count(v).alias("_n"), F.sum(v).alias("_sum"),
        F.min(v).alias("_min"), F.max(v).alias("_max"))


def _met(layer: Layer, raster: Raster, band: int, width: int = TILE) -> DataFrame:
    """Runs of zones with the tiles they meet; ``_whole`` where the run holds the whole tile."""
    spans = zone_spans(layer, raster).select(
        "*", F.explode(F.sequence(F.floor(F.col("_first") / width), F.floor(F.col("_last") / width))).alias("_tile"))
    whole = (F.col("_first") <= F.col("_tile") * width) & (F.col("_last") >= F.col("_tile") * width + (width - 1))
    return spans.withColumn("_whole", whole).join(row_tiles(raster, band, width), ["_row", "_tile"])


def _covered(layer: Layer, raster: Raster, band: int) -> DataFrame:
    """(key, value) of every cell whose centre a feature covers."""
    some = F.expr("if(_whole, _cells, filter(_cells, c -> c.col BETWEEN _first AND _last))")
    return _met(layer, raster, band).select(*layer.pk, F.explode(some).alias("_c")).select(
        *layer.pk, F.col("_c.value").alias("value"))


def _from_totals(layer: Layer, raster: Raster, band: int) -> DataFrame:
    """n, sum, min, max and mean per zone; only tiles on a zone's border are looked into."""
    part = F.expr("""if(_whole, named_struct('n', _n, 'sum', cast(_sum AS double), 'min', _min, 'max', _max),
        transform(array(filter(_cells, c -> c.col BETWEEN _first AND _last)), s -> named_struct('n', cast(size(s) AS bigint),
        'sum', aggregate(s, 0D, (t, c) -> t + c.value), 'min', array_min(s.value), 'max', array_max(s.value)))[0])""")
    parts = _met(layer, raster, band).select(*layer.pk, part.alias("p"))
    sums = parts.groupBy(*layer.pk).agg(F.sum("p.n").alias("n"), F.sum("p.sum").alias("sum"), F.min("p.min").alias("min"),
                                        F.max("p.max").alias("max")).where("n > 0")
    return sums.withColumn("mean", F.col("sum") / F.col("n"))


def _from_counts(counted: DataFrame, pk: list[str]) -> DataFrame:
    """All statistics from the counts of equal values, which the median needs anyway."""
    v, n = F.col("value"), F.col("_n")
    sums = counted.groupBy(*pk).agg(
        F.sum(n).alias("n"), F.sum(v * n).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
    sums = sums.withColumn("mean", F.col("sum") / F.col("n"))
    spread = same_keys(counted, sums.select(*pk, "mean", "n"), pk).groupBy(*pk).agg(
        F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.max("n")).alias("std"))
    return same_keys(same_keys(sums, spread, pk), exact_median(counted, pk, "value", weight="_n"), pk)


def zonal_stats(layer: Layer, raster: Raster, band: int = 1, stats: Iterable[str] = STATS) -> DataFrame:
    """Key and statistics of the cells whose centre a feature covers; NULL where it covers none."""
    stats = tuple(stats)
    unknown = set(stats) - set(STATS)
    if unknown:
        raise ValueError(f"unknown statistic {', '.join(sorted(unknown))}")
    pk = list(layer.pk)
    if {"median", "std"} & set(stats):
        counted = _covered(layer, raster, band).groupBy(*pk, "value").agg(F.count("*").alias("_n"))
        per_zone = _from_counts(settle(counted), pk)
    else:
        per_zone = _from_totals(layer, raster, band)
    out = layer.keys().join(per_zone.select(*layer.pk, *stats), list(layer.pk), "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))) if "n" in stats else out


def mean_under(layer: Layer, raster: Raster, band: int = 1) -> DataFrame:
    return zonal_stats(layer, raster, band, ("mean",))


def zonal_filter(zonal: DataFrame, criteria: Sequence[tuple], op: str = "AND") -> DataFrame:
    """Zones whose statistics meet the criteria ``(stat, comparison, threshold[, upper])``."""
    tests = [compare(F.col(stat), comparison, *bounds) for stat, comparison, *bounds in criteria]
    return zonal.where((all_of if op.upper() == "AND" else any_of)(tests))


def histogram(layer: Layer, raster: Raster, band: int, bins: int, low: float, high: float) -> DataFrame:
    """(key, bin, n): cells a feature covers per value bin; the last bin holds ``high`` too."""
    v = F.col("value")
    number = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)) + 1
    inside = _covered(layer, raster, band).where(v.between(low, high))
    return inside.groupBy(*layer.pk, number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def filter_points(layer: Layer, classes: Iterable | None = None, z: tuple[float, float] | None = None,
                  where: Column | str | None = None, clip: Layer | None = None, class_column: str = "classification",
                  z_column: str = "z") -> DataFrame:
    """Point-cloud filter: classification set, height range (both ends in), attribute, clip polygons."""
    tests = []
    if classes is not None:
        tests.append(F.col(class_column).isin(list(classes)))
    if z is not None:
        tests.append(compare(F.col(z_column), "BETWEEN", *z))
    if where is not None:
        tests.append(as_column(where))
    kept = layer.where(all_of(tests)) if tests else layer
    return kept.df if clip is None else spatial_filter(kept, clip)
