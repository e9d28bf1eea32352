"""Well-known binary by hand-packed bytes, and there and back."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from geosieve.functions import geometry as geo
from geosieve.functions.wkb import from_wkb, to_wkb
from geosieve.sources import readers


def pack(code, body, order="<"):
    return struct.pack(order + "BI", order == "<", code) + body


def xy(*values, order="<"):
    return struct.pack(f"{order}{len(values)}d", *values)


def n(count, order="<"):
    return struct.pack(order + "I", count)


RING = n(4) + xy(0, 0, 4, 0, 0, 4, 0, 0)
POLYGON = pack(3, n(1) + RING)
BYTES = {
    "point": (pack(1, xy(1, 2)), "POINT (1 2)"),
    "big endian": (pack(1, xy(1, 2, order=">"), ">"), "POINT (1 2)"),
    "empty point": (pack(1, xy(float("nan"), float("nan"))), "POINT EMPTY"),
    "line": (pack(2, n(2) + xy(0, 0, 1.5, 1)), "LINESTRING (0 0, 1.5 1)"),
    "line with Z": (pack(1002, n(2) + xy(0, 0, 9, 1, 1, 9)), "LINESTRING (0 0, 1 1)"),
    "line with ZM": (pack(3002, n(2) + xy(0, 0, 9, 8, 1, 1, 9, 8)), "LINESTRING (0 0, 1 1)"),
    "extended with system and Z": (pack(0xA0000001, n(4326) + xy(5, 6, 7)), "POINT (5 6)"),
    "polygon": (POLYGON, "POLYGON ((0 0, 4 0, 0 4, 0 0))"),
    "holes": (pack(3, n(2) + RING + n(4) + xy(1, 1, 1, 2, 2, 1, 1, 1)), "POLYGON ((0 0, 4 0, 0 4, 0 0), (1 1, 1 2, 2 1, 1 1))"),
    "points": (pack(4, n(2) + pack(1, xy(1, 2)) + pack(1, xy(3, 4, order=">"), ">")), "MULTIPOINT (1 2, 3 4)"),
    "lines": (pack(5, n(1) + pack(2, n(2) + xy(0, 0, 1, 1))), "MULTILINESTRING ((0 0, 1 1))"),
    "polygons": (pack(6, n(2) + POLYGON + POLYGON), "MULTIPOLYGON (((0 0, 4 0, 0 4, 0 0)), ((0 0, 4 0, 0 4, 0 0)))"),
    "collection": (pack(7, n(3) + pack(1, xy(1, 2)) + POLYGON + pack(2, n(2) + xy(0, 0, 1, 1))),
                   "MULTIPOLYGON (((0 0, 4 0, 0 4, 0 0)))"),
    "collection of lines": (pack(7, n(2) + pack(1, xy(1, 2)) + pack(7, n(1) + pack(2, n(2) + xy(0, 0, 1, 1)))),
                            "MULTILINESTRING ((0 0, 1 1))"),
    "empty collection": (pack(7, n(0)), "MULTIPOINT EMPTY"),
    "empty polygon": (pack(3, n(0)), "POLYGON EMPTY"),
    "null": (None, None),
    "no bytes": (b"", None),
    "cut off": (POLYGON[:-3], None),
    "too long": (POLYGON + b"x", None),
    "no type": (pack(99, b""), None),
    "no order": (b"\x07" + POLYGON[1:], None),
    "many points promised": (pack(2, n(0xFFFFFFFF)), None),
}


@pytest.fixture(scope="module")
def shapes(spark):
    df = spark.createDataFrame([(k, b) for k, (b, _) in BYTES.items()], "name string, bytes binary")
    return df.repartition(3).withColumn("geom", from_wkb(F.col("bytes")))


def test_reads_all_kinds(shapes):
    got = {r.name: r.wkt for r in shapes.select("name", geo.to_wkt(F.col("geom")).alias("wkt")).collect()}
    assert got == {k: wkt for k, (_, wkt) in BYTES.items()}


def test_there_and_back(shapes):
    back = shapes.withColumn("again", from_wkb(to_wkb(F.col("geom"))))
    for r in back.collect():
        assert (r.geom is None) == (r.again is None), r.name
        if r.geom is not None and r.geom.parts:
            assert r.again == r.geom, r.name
    plain = [r.name for r in shapes.where(to_wkb(F.col("geom")) == F.col("bytes")).collect()]
    assert {"point", "line", "polygon", "holes", "lines", "polygons", "empty polygon"} <= set(plain)


def test_layer_of_wkb_files(spark, shapes, tmp_path):
    shapes.select("name", F.col("bytes").alias("geometry")).write.parquet(f"{tmp_path}/geo")
    layer = readers.read_layer(spark, "geoparquet", f"{tmp_path}/geo", ("name",))
    assert layer.df.columns == ["name", "geom"]
    assert layer.df.where(layer.geometry.present()).count() == sum(
        w is not None and "EMPTY" not in w for _, w in BYTES.values())
    named = readers.read_layer(spark, "parquet", f"{tmp_path}/geo", ("name",), wkb="geometry")
    assert named.df.count() == len(BYTES)
