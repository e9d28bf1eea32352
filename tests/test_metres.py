"""UTM both ways and distances on the ellipsoid, against an independent iteration and known positions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geosieve.functions import crs
from geosieve.layer import BoxColumns, Layer, PointColumns
from geosieve.operators.spatial import spatial_filter, spatial_pairs


def inverse_distance(lon1, lat1, lon2, lat2):
    """Geodesic on the ellipsoid by Vincenty's iteration."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    turn = math.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = turn
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam),
                           math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2_a = 1 - sin_a**2
        cos_2m = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2_a if cos2_a else 0.0
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        old, lam = lam, turn + (1 - c) * f * sin_a * (
            sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
        if abs(lam - old) < 1e-13:
            break
    k = cos2_a * (a * a - b * b) / (b * b)
    big_a = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
    big_b = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    d = big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (
        4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
    return b * big_a * (sigma - d)


def lonlat(spark, rows):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id long, lon double, lat double")
    return Layer(df, ("id",), PointColumns("lon", "lat"), "EPSG:4326")


def test_known_utm_positions(spark):
    # the first lies on its meridian; the second is a published example of zone 17
    rows = spark.createDataFrame([(9.0, 0.0, 32632), (-79.387139, 43.642567, 32617), (151.0, -33.0, 32756)],
                                 "lon double, lat double, code int")
    got = rows.select(*crs.to_utm(F.col("lon"), F.col("lat"), F.col("code"))).collect()
    assert got[0][0] == pytest.approx(500000, abs=1e-6) and got[0][1] == pytest.approx(0, abs=1e-6)
    assert got[1][0] == pytest.approx(630084, abs=1) and got[1][1] == pytest.approx(4833438, abs=1)
    assert got[2][1] > 6_000_000
    assert rows.select(*crs.to_utm(F.col("lon"), F.col("lat"), 3857)).first()[0] is None


def test_utm_round_trip(spark):
    r = random.Random(3)
    layer = lonlat(spark, [(r.uniform(3, 15), r.uniform(-80, 84)) for _ in range(500)])
    for code in ("EPSG:32632", "EPSG:32732"):
        moved = crs.reproject(layer, code)
        assert moved.crs == code
        back = crs.reproject(moved, "EPSG:4326").df.collect()
        for a, b in zip(layer.df.collect(), back):
            assert b.lon == pytest.approx(a.lon, abs=1e-8) and b.lat == pytest.approx(a.lat, abs=1e-8)
    over = crs.reproject(crs.reproject(layer, "EPSG:32632"), "EPSG:32633")
    direct = crs.reproject(layer, "EPSG:32633").df.collect()
    for a, b in zip(direct, over.df.collect()):
        assert b.lon == pytest.approx(a.lon, abs=1e-3) and b.lat == pytest.approx(a.lat, abs=1e-3)
    boxes = Layer(layer.df.selectExpr("id", "lon AS xmin", "lat AS ymin", "lon AS xmax", "lat AS ymax"), ("id",),
                  BoxColumns(), "EPSG:4326")
    with pytest.raises(ValueError, match="as_shapes"):
        crs.reproject(boxes, "EPSG:32632")
    assert crs.reproject(boxes.as_shapes(), "EPSG:32632").df.count() == 500
    with pytest.raises(ValueError, match="no transformation"):
        crs.reproject(layer, "EPSG:2154")


def test_distances_on_the_ellipsoid(spark):
    r, rows = random.Random(5), []
    for _ in range(400):
        lat, far = r.uniform(-85, 85), r.choice([0.01, 0.5, 4.0])
        lon = r.choice([r.uniform(-180, 180), 179.99, -179.99])
        rows.append((lon, lat, lon + r.uniform(-far, far), max(-89.0, min(89.0, lat + r.uniform(-far, far)))))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    sx, sy = crs.to_mercator(F.col("a"), F.col("b"))
    tx, ty = crs.to_mercator(F.col("c"), F.col("d"))
    got = df.select(sx.alias("sx"), sy.alias("sy"), tx.alias("tx"), ty.alias("ty")).selectExpr(
        crs.metre_gap_sql("tx", "ty", "sx", "sy") + " AS m").collect()
    for (a, b, c, d), found in zip(rows, got):
        assert found.m == pytest.approx(inverse_distance(a, b, c, d), rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_radius_at_high_latitudes_and_the_date_line(spark, strategy):
    r = random.Random(9)
    places = [(r.uniform(-180, 180), r.uniform(-70, 70)) for _ in range(150)]
    places += [(r.choice([180 - r.uniform(0, 1), r.uniform(0, 1) - 180]), r.uniform(58, 62)) for _ in range(150)]
    places += [(r.uniform(9, 11), r.uniform(59.5, 60.5)) for _ in range(150)]
    layer = lonlat(spark, places)
    got = {tuple(x) for x in spatial_pairs(layer, layer, radius=30_000, metric="geodesic", strategy=strategy).collect()}
    for i, a in enumerate(places):
        for j, b in enumerate(places):
            d = inverse_distance(*a, *b)
            if abs(d - 30_000) > 30:  # a thousandth
                assert ((i, j) in got) == (d < 30_000), (a, b, d)
    some = layer.where("id < 40")
    kept = {x.id for x in spatial_filter(layer, some, radius=30_000, metric="geodesic", strategy=strategy).collect()}
    assert kept == {i for i, j in got if j < 40}
    apart = spatial_filter(layer, some, "disjoint", radius=30_000, metric="geodesic", mode="all", strategy=strategy)
    assert {x.id for x in apart.collect()} == set(range(450)) - kept
    assert any(abs(places[i][0] - places[j][0]) > 300 for i, j in got)


def test_radius_per_row(spark):
    layer = lonlat(spark, [(0, 60), (0.1, 60), (0.3, 60), (0, 60)])
    source = layer.where("id = 0")
    source = source.with_df(source.df.withColumn("r", F.lit(6000.0)))
    got = {x.id for x in spatial_filter(layer, source, radius="r", metric="geodesic").collect()}
    assert got == {0, 1, 3}  # a tenth of a degree is 5.6 km there, and 11.1 km at the equator
    with pytest.raises(ValueError, match="geodesic"):
        spatial_filter(layer, source, radius=-5, metric="geodesic")
    with pytest.raises(ValueError, match="geodesic"):
        spatial_filter(layer, source.as_shapes(), radius=5, metric="geodesic")
