"""Runs of cells under zones against the spatial join of all cell centres, and statistics against plain lists."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from geosieve.functions.geometry import from_wkt
from geosieve.layer import BoxColumns, Layer, PointColumns
from geosieve.operators import raster as rs
from geosieve.operators.spatial import spatial_pairs

ZONES = {
    1: "POLYGON ((1 1, 9 1, 9 9, 1 9, 1 1))",
    2: "POLYGON ((0.5 0.5, 6.5 0.5, 6.5 6.5, 0.5 6.5, 0.5 0.5), (2.5 2.5, 2.5 4.5, 4.5 4.5, 4.5 2.5, 2.5 2.5))",
    3: "POLYGON ((0.5 0.5, 7.5 0.5, 7.5 3.5, 3.5 3.5, 3.5 9.5, 0.5 9.5, 0.5 0.5))",
    4: "POLYGON ((5 0, 10 5, 5 10, 0 5, 5 0))",
    5: "POLYGON ((2.5 2.5, 5.5 8.5, 8.5 2.5, 2.5 2.5))",
    6: "MULTIPOLYGON (((1 1, 3 1, 3 3, 1 3, 1 1)), ((5.5 1, 8.5 1, 7 7.5, 5.5 1)))",
    7: "LINESTRING (0.5 0.5, 8.5 0.5, 8.5 6.5, 4.5 2.5)",
    8: "LINESTRING (0 0, 9 4.5)",
    9: "POINT (3.5 4.5)",
    10: "POINT (3.4 4.5)",
    11: "POLYGON ((4.6 4.6, 4.9 4.6, 4.9 4.9, 4.6 4.9, 4.6 4.6))",
    12: "POLYGON ((-5 -5, 25 -5, 25 3.2, -5 3.2, -5 -5))",
    13: "MULTIPOINT (0.5 0.5, 1.5 1.5, 0.5 0.5)",
    14: "MULTILINESTRING ((1.5 0, 1.5 9), (1.5 3, 1.5 12))",
    15: None,
    16: "POLYGON EMPTY",
}


@pytest.fixture(scope="module")
def raster(spark):
    r = random.Random(2)
    rows = [(b, c, w, None if r.random() < 0.2 else float(r.randrange(50))) for b in (1, 2) for c in range(12) for w in range(11)
            if r.random() < 0.95]
    return rs.Raster(spark.createDataFrame(rows, "band int, col long, row long, value double"))


@pytest.fixture(scope="module")
def zones(spark):
    df = spark.createDataFrame(list(ZONES.items()), "id long, wkt string")
    return Layer(df.withColumn("geom", from_wkt(F.col("wkt"))), ("id",))


def centres(raster):
    df = raster.cells.where("band = 1").select("col", "row", "value", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return Layer(df, ("col", "row"), PointColumns())


def covered(raster, zones):
    pairs = spatial_pairs(centres(raster), zones)
    values = {(r["col"], r["row"]): r.value for r in centres(raster).df.collect()}
    out = {i: [] for i in ZONES}
    for r in pairs.collect():
        if values[r.t_col, r.t_row] is not None:
            out[r.s_id].append(values[r.t_col, r.t_row])
    return out


def test_spans_are_the_covered_centres(spark, raster, zones):
    grid = spark.range(-6, 27).select(F.col("id").alias("col")).join(spark.range(-6, 12).select(F.col("id").alias("row")))
    points = Layer(grid.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5}), ("col", "row"), PointColumns())
    want = {(r.s_id, r.t_col, r.t_row) for r in spatial_pairs(points, zones).collect()}
    spans = rs.zone_spans(zones, raster).collect()
    got = [(r.id, c, r._row) for r in spans for c in range(r._first, r._last + 1)]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(spans) < len(got) / 3


@pytest.mark.parametrize("width", [1, 4, 256])
def test_totals_and_values(raster, zones, width, monkeypatch):
    monkeypatch.setattr(rs, "TILE", width)
    monkeypatch.setattr(rs._met, "__defaults__", (width,))
    want = covered(raster, zones)
    assert sum(map(len, want.values())) > 100
    light = {r.id: r for r in rs.zonal_stats(zones, raster, 1, ("n", "sum", "min", "max", "mean")).collect()}
    full = {r.id: r for r in rs.zonal_stats(zones, raster).collect()}
    assert light.keys() == full.keys() == want.keys()
    for i, values in want.items():
        for r in (light[i], full[i]):
            assert r.n == len(values)
            if values:
                assert (r.sum, r.min, r.max) == (sum(values), min(values), max(values))
                assert r["mean"] == pytest.approx(statistics.fmean(values))
            else:
                assert r["sum"] is None and r["mean"] is None
        if values:
            assert full[i].median == statistics.median(values)
            assert full[i].std == pytest.approx(statistics.pstdev(values))
    bins = {(r.id, r.bin): r.n for r in rs.histogram(zones, raster, 1, 5, 0, 50).collect()}
    for (i, b), n in bins.items():
        assert n == sum(min(int(v // 10), 4) + 1 == b for v in want[i])
    assert sum(bins.values()) == sum(map(len, want.values()))


def test_boxes_and_points_as_zones(spark, raster):
    boxes = Layer(spark.createDataFrame([(1, 0.5, 0.5, 2.5, 2.5), (2, 5.0, 5.0, 5.0, 5.0)],
                                        "id long, xmin double, ymin double, xmax double, ymax double"), ("id",), BoxColumns())
    spans = {(r.id, r._row, r._first, r._last) for r in rs.zone_spans(boxes, raster).collect()}
    assert spans == {(1, 0, 0, 2), (1, 1, 0, 2), (1, 2, 0, 2)}
    points = Layer(spark.createDataFrame([(1, 4.5, 3.5), (2, 4.4, 3.5)], "id long, x double, y double"), ("id",), PointColumns())
    assert [tuple(r) for r in rs.zone_spans(points, raster).select("id", "_row", "_first", "_last").collect()] == [(1, 3, 4, 4)]


def test_sampling_stats_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(3.0, 1), (3.0, 2), (None, 3), (1.0, 4), (8.0, 5)], "band_1 double, id long")
    r = rs.sampling_stats(df, matching="id >= 2 AND band_1 > 1").first()
    assert (r.total, r.sampled, r.nodata, r.matching, r.min_value, r.max_value, r.median_value) == (5, 4, 1, 2, 1, 8, 3)
    assert r.mean_value == 3.75 and r.std_value == pytest.approx(statistics.pstdev([3, 3, 1, 8]))
    r = rs.sampling_stats(df.where("band_1 IS NULL")).first()
    assert (r.total, r.sampled, r.nodata, r.matching, r.mean_value) == (1, 0, 1, 0, None)
