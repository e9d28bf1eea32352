"""Coordinate systems: 4326, 3857 and the UTM zones, both ways, and distances in metres.

Distances in 3857 are stretched by 1 / cos(latitude). ``metre_gap_sql`` measures on the ellipsoid instead: each source
position has a transverse Mercator projection of its own, around its meridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geosieve.layer import SHAPE_DDL, BoxColumns, Layer, PointColumns

# Fixed values.
GEOGRAPHIC = "EPSG:4326"
METRIC = "EPSG:3857"
EARTH_RADIUS = 6378137.0
METRES_PER_DEGREE = 111000.0
FLATTENING = 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0

# Kruger's series for the transverse Mercator projection, in the third flattening
_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = EARTH_RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACKWARD = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
MEAN_RADIUS = 6371008.8
HALF_WORLD = EARTH_RADIUS * math.pi  # of 3857


def is_geographic(crs: str) -> bool:
    code = crs.rpartition(":")[2]
    return code.isdigit() and 4000 < int(code) < 5000


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    k = EARTH_RADIUS * math.pi / 180
    return lon * F.lit(k), F.log(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360))) * F.lit(EARTH_RADIUS)


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    k = 180 / (EARTH_RADIUS * math.pi)
    lat = (F.atan(F.exp(y / F.lit(EARTH_RADIUS))) * 2 - F.lit(math.pi / 2)) * F.lit(180 / math.pi)
    return x * F.lit(k), lat


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Code of the UTM zone of a position, 3857 where there is none."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    code = F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)
    return F.when(zone.between(1, 60), code).otherwise(F.lit(3857))


def to_transverse(lon: Column, lat: Column, meridian: Column) -> tuple[Column, Column]:
    """Easting and northing in metres around a meridian (degrees), with true scale along it."""
    names = {"lon": lon, "lat": lat, "meridian": meridian}
    p = F.struct(*[c.cast("double").alias(n) for n, c in names.items()])

    def project(p):
        rad = math.pi / 180
        sin_lat = F.sin(p["lat"] * rad)
        psi = F.atanh(sin_lat) - F.lit(_E) * F.atanh(F.lit(_E) * sin_lat)
        turn = (p["lon"] - p["meridian"]) * rad
        s = F.sinh(psi)
        return F.struct(F.atan2(s, F.cos(turn)).alias("up"), F.asinh(F.sin(turn) / F.hypot(s, F.cos(turn))).alias("out"))

    def sums(v):
        north, east = v["up"], v["out"]
        for j, a in enumerate(_FORWARD, 1):
            north += F.lit(a) * F.sin(2 * j * v["up"]) * F.cosh(2 * j * v["out"])
            east += F.lit(a) * F.cos(2 * j * v["up"]) * F.sinh(2 * j * v["out"])
        return F.struct((east * _RADIUS).alias("e"), (north * _RADIUS).alias("n"))

    out = F.transform(F.transform(F.array(p), project), sums)[0]
    return out["e"], out["n"]


def from_transverse(east: Column, north: Column, meridian: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a position around a meridian."""
    p = F.struct((east / _RADIUS).alias("out"), (north / _RADIUS).alias("up"))

    def back(v):
        up, out = v["up"], v["out"]
        for j, b in enumerate(_BACKWARD, 1):
            up -= F.lit(b) * F.sin(2 * j * v["up"]) * F.cosh(2 * j * v["out"])
            out -= F.lit(b) * F.cos(2 * j * v["up"]) * F.sinh(2 * j * v["out"])
        return F.struct(up.alias("up"), out.alias("out"))

    def position(v):
        chi = F.asin(F.sin(v["up"]) / F.cosh(v["out"]))
        return F.struct(F.atan2(F.sinh(v["out"]), F.cos(v["up"])).alias("turn"), chi.alias("chi"))

    def latitude(v):
        lat = v["chi"]
        for j, d in enumerate(_LATITUDE, 1):
            lat += F.lit(d) * F.sin(2 * j * v["chi"])
        return F.struct((v["turn"] * (180 / math.pi)).alias("turn"), (lat * (180 / math.pi)).alias("lat"))

    out = F.transform(F.transform(F.transform(F.array(p), back), position), latitude)[0]
    lon = out["turn"] + meridian
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon), out["lat"]


def _utm(code: int) -> tuple[float, float] | None:
    """Central meridian and false northing of a UTM zone."""
    zone, south = code % 100, code // 100 == 327
    return (6.0 * zone - 183, UTM_SOUTH * south) if code // 100 in (326, 327) and 1 <= zone <= 60 else None


def to_utm(lon: Column, lat: Column, epsg: Column | int) -> tuple[Column, Column]:
    """Position in a UTM zone, which may differ from row to row; null for other codes."""
    code = epsg if isinstance(epsg, Column) else F.lit(epsg)
    zone, side = code % 100, F.floor(code / 100)
    known = side.isin(326, 327) & zone.between(1, 60)
    e, n = to_transverse(lon, lat, zone * 6 - 183)
    north = n * UTM_SCALE + F.when(side == 327, UTM_SOUTH).otherwise(0.0)
    return F.when(known, e * UTM_SCALE + UTM_EAST), F.when(known, north)


def from_utm(x: Column, y: Column, epsg: Column | int) -> tuple[Column, Column]:
    code = epsg if isinstance(epsg, Column) else F.lit(epsg)
    zone, side = code % 100, F.floor(code / 100)
    known = side.isin(326, 327) & zone.between(1, 60)
    north = (y - F.when(side == 327, UTM_SOUTH).otherwise(0.0)) / UTM_SCALE
    lon, lat = from_transverse((x - UTM_EAST) / UTM_SCALE, north, zone * 6 - 183)
    return F.when(known, lon), F.when(known, lat)


def metre_gap_sql(tx: str, ty: str, sx: str, sy: str) -> str:
    """Metres between two positions given in 3857, as expression text; meant for less than some 500 km.

    The target is projected around the source's meridian, where the scale is 1, and the scale on the way is averaged.
    """
    def isometric(y: str) -> str:
        sin_lat = f"tanh({y} / {EARTH_RADIUS!r}D)"
        return f"({y} / {EARTH_RADIUS!r}D - {_E!r}D * atanh({_E!r}D * {sin_lat}))"

    series = list(enumerate(_FORWARD, 1))
    north = " + ".join(["q.up", *[f"{a!r}D * sin({2 * j} * q.up) * cosh({2 * j} * q.out)" for j, a in series]])
    east = " + ".join(["q.out", *[f"{a!r}D * cos({2 * j} * q.up) * sinh({2 * j} * q.out)" for j, a in series]])
    start = " + ".join(["q.base", *[f"{a!r}D * sin({2 * j} * q.base)" for j, a in series]])
    point = f"named_struct('t', {isometric(ty)}, 's', {isometric(sy)}, 'turn', ({tx} - {sx}) / {EARTH_RADIUS!r}D)"
    angles = ("named_struct('up', atan2(sinh(p.t), cos(p.turn)), 'out', asinh(sin(p.turn) / "
              "sqrt(pow(sinh(p.t), 2) + pow(cos(p.turn), 2))), 'base', atan(sinh(p.s)))")
    metres = f"named_struct('n', ({north} - ({start})) * {_RADIUS!r}D, 'e', ({east}) * {_RADIUS!r}D)"
    gap = f"sqrt(pow(m.n, 2) + pow(m.e, 2)) / (1 + pow(m.e, 2) / {6 * MEAN_RADIUS ** 2!r}D)"
    return f"transform(transform(transform(array({point}), p -> {angles}), q -> {metres}), m -> {gap})[0]"


def metre_bounds_sql(tx: str, ty: str, sx: str, sy: str, metres: str) -> tuple[str, str]:
    """What says without ``metre_gap_sql`` that two positions in 3857 are surely, or never, within so many metres.

    A length in 3857 is shortened by the cosine of the latitude, on the ellipsoid by up to 0.4 % more or 0.7 % more than that;
    2 % are left for that and for the formula. Neither holds for less than a metre, beyond 200 km, or near a pole,
    where the way does not keep to the latitudes of its ends.
    """
    t, s = (f"cosh({y} / {EARTH_RADIUS!r}D)" for y in (ty, sy))
    gap = f"sqrt(({tx} - {sx}) * ({tx} - {sx}) + ({ty} - {sy}) * ({ty} - {sy}))"
    most, least = f"if({ty} * {sy} <= 0, 1D, least({t}, {s}))", f"greatest({t}, {s})"
    fits = f"{metres} BETWEEN 1D AND 200000D AND 20 * {metres} * {least} < {EARTH_RADIUS!r}D"
    return f"({fits} AND 1.02D * {gap} < {metres} * {most})", f"({fits} AND 0.98D * {gap} > {metres} * {least})"


def mercator_reach(y: Column, metres: Column) -> Column:
    """A distance in 3857 that holds a circle of so many metres around a height ``y``, with a margin of a hundredth."""
    lat = F.abs(F.atan(F.exp(y / EARTH_RADIUS)) * 2 - math.pi / 2)
    far = F.least(lat + metres * (1.01 / EARTH_RADIUS), F.lit(math.radians(89.9)))
    return metres * 1.01 / F.cos(far)


def _transform_for(src: str, dst: str):
    if (src, dst) == (GEOGRAPHIC, METRIC):
        return to_mercator
    if (src, dst) == (METRIC, GEOGRAPHIC):
        return from_mercator
    codes = [int(x.rpartition(":")[2]) if x.rpartition(":")[2].isdigit() else 0 for x in (src, dst)]
    into, out_of = (_utm(code) is not None for code in codes[::-1])
    if src == GEOGRAPHIC and into:
        return lambda lon, lat: to_utm(lon, lat, codes[1])
    if dst == GEOGRAPHIC and out_of:
        return lambda x, y: from_utm(x, y, codes[0])
    if (src == METRIC or out_of) and (dst == METRIC or into):
        first, second = _transform_for(src, GEOGRAPHIC), _transform_for(GEOGRAPHIC, dst)
        return lambda x, y: second(*first(x, y))
    raise ValueError(f"no transformation from {src} to {dst}")


def reproject(layer: Layer, to: str) -> Layer:
    """The layer in another coordinate system; the geometry columns are replaced."""
    if layer.crs == to:
        return layer
    f = _transform_for(layer.crs, to)
    g, df = layer.geometry, layer.df
    if isinstance(g, PointColumns):
        x, y = f(F.col(g.x), F.col(g.y))
        df = df.withColumns({g.x: x, g.y: y})
    elif isinstance(g, BoxColumns) and {layer.crs, to} != {GEOGRAPHIC, METRIC}:
        raise ValueError("a box is no box in a UTM zone: take the layer's as_shapes()")
    elif isinstance(g, BoxColumns):
        # both formulas are monotone in each axis, so a box stays a box
        xmin, ymin = f(F.col(g.xmin), F.col(g.ymin))
        xmax, ymax = f(F.col(g.xmax), F.col(g.ymax))
        df = df.withColumns({g.xmin: xmin, g.ymin: ymin, g.xmax: xmax, g.ymax: ymax})
    else:
        def move(p):
            x, y = f(p["x"], p["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        geom = F.col(g.name)
        parts = F.transform(geom["parts"], lambda part: F.transform(part, lambda r: F.transform(r, move)))
        df = df.withColumn(g.name, F.when(
            geom.isNotNull(), F.struct(geom["type"].alias("type"), parts.alias("parts")).cast(SHAPE_DDL)))
    return Layer(df, layer.pk, g, to, layer.name)


def in_metres(layer: Layer) -> Layer:
    """The layer in a system whose unit is the metre."""
    return reproject(layer, METRIC) if is_geographic(layer.crs) else layer
