"""Geometry accessors, measures and constructors as Column expressions over the geometry struct."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geosieve.layer import SHAPE_DDL, finite

# Decimals written in WKT.
WKT_DECIMALS_GEOGRAPHIC = 8
WKT_DECIMALS_PROJECTED = 3


def _pt(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def make_shape(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts")).cast(SHAPE_DDL)


def make_point(x: Column, y: Column) -> Column:
    return make_shape("POINT", F.array(F.array(F.array(_pt(x, y)))))


def make_line(*xy: tuple[Column, Column]) -> Column:
    return make_shape("LINESTRING", F.array(F.array(F.array(*[_pt(x, y) for x, y in xy]))))


def ring(*xy: tuple[Column, Column]) -> Column:
    """A closed ring through the given corners."""
    corners = [_pt(x, y) for x, y in xy]
    return F.array(*corners, corners[0])


def make_polygon(*rings: Column) -> Column:
    return make_shape("POLYGON", F.array(F.array(*rings)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


# --- structure -------------------------------------------------------------------------------------


def rings(geom: Column) -> Column:
    return F.filter(F.flatten(geom["parts"]), lambda r: F.size(r) > 0)


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def _ring_edges(r: Column) -> Column:
    edge = lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
    )
    return F.when(F.size(r) == 1, F.transform(r, lambda p: edge(p, p))).otherwise(
        F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), edge)
    )


def edges(geom: Column) -> Column:
    """All edges of all rings; a lone vertex is an edge without length."""
    return F.flatten(F.transform(rings(geom), _ring_edges))


def edges_sql(geom: str) -> str:
    """``edges`` as expression text, for a geometry given as text."""
    edge = "named_struct('x1', {0}.x, 'y1', {0}.y, 'x2', {1}.x, 'y2', {1}.y)"
    return (f"flatten(transform(filter(flatten({geom}.parts), r -> size(r) > 0), r -> if(size(r) = 1, "
            f"transform(r, p -> {edge.format('p', 'p')}), "
            f"zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (p, q) -> {edge.format('p', 'q')}))))")


def line_ends_sql(geom: str) -> str:
    """First and last vertex of every line part, as expression text."""
    return (f"flatten(transform(filter(flatten({geom}.parts), r -> size(r) > 0), "
            f"r -> array(r[0], element_at(r, -1))))")


def geometry_type(geom: Column) -> Column:
    return geom["type"]


def num_points(geom: Column) -> Column:
    return F.size(vertices(geom))


def num_geometries(geom: Column) -> Column:
    return F.size(geom["parts"])


def geometry_n(geom: Column, n: Column | int) -> Column:
    """The n-th part (from 1) as a single-part geometry."""
    part = F.try_element_at(geom["parts"], _int(n))
    single = F.regexp_replace(geom["type"], "^MULTI", "")
    return F.when(part.isNotNull(), F.struct(single.alias("type"), F.array(part).alias("parts")))


def exterior_ring(geom: Column) -> Column:
    shell = geom["parts"][0][0]
    return F.when(
        geom["type"].endswith("POLYGON"),
        F.struct(F.lit("LINESTRING").alias("type"), F.array(F.array(shell)).alias("parts")),
    )


def point_n(geom: Column, n: Column | int) -> Column:
    """The n-th vertex (from 1, negative counts from the end) as ``struct<x, y>``."""
    return F.try_element_at(vertices(geom), _int(n))


def start_point(geom: Column) -> Column:
    return point_n(geom, 1)


def end_point(geom: Column) -> Column:
    return point_n(geom, -1)


def _int(n: Column | int) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(n)


def bbox(geom: Column) -> tuple[Column, Column, Column, Column]:
    v = vertices(geom)
    return F.array_min(v["x"]), F.array_min(v["y"]), F.array_max(v["x"]), F.array_max(v["y"])


def envelope(geom: Column) -> Column:
    xmin, ymin, xmax, ymax = bbox(geom)
    return F.when(xmin.isNotNull(),
                  make_polygon(ring((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))))


def explode_type(kind: Column) -> Column:
    return F.regexp_replace(kind, "^MULTI", "")


# --- measures --------------------------------------------------------------------------------------


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def _ring_area(r: Column) -> Column:
    return F.abs(_sum(_ring_edges(r), _cross)) / 2


def _part_area(part: Column) -> Column:
    return _ring_area(part[0]) - _sum(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), _ring_area)


def area(geom: Column) -> Column:
    """Planar area; holes are taken off, lines and points have none."""
    return F.when(geom["type"].endswith("POLYGON"),
                  _sum(F.filter(geom["parts"], lambda p: F.size(p) > 0), _part_area)).otherwise(
        F.when(geom.isNotNull(), F.lit(0.0)))


def _edge_length(e: Column) -> Column:
    return F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])


def _edge_sum(geom: Column) -> Column:
    return _sum(edges(geom), _edge_length)


def length(geom: Column) -> Column:
    return F.when(geom["type"].endswith("LINESTRING"), _edge_sum(geom)).otherwise(
        F.when(geom.isNotNull(), F.lit(0.0)))


def perimeter(geom: Column) -> Column:
    return F.when(geom["type"].endswith("POLYGON"), _edge_sum(geom)).otherwise(
        F.when(geom.isNotNull(), F.lit(0.0)))


def centroid(geom: Column) -> Column:
    """Area-weighted for polygons, length-weighted for lines, mean of the vertices for points.

    A polygon without area falls back to its edges, edges without length to the vertices.
    """
    names = ("a", "ax", "ay", "l", "lx", "ly")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def plus(acc, values):
        return F.struct(*[(acc[n] + v).alias(n) for n, v in zip(names, values)])

    def moments(origin):
        # positions count from the first vertex and divisions come last, so that round figures stay exact
        def add_edge(acc, e):
            x1, y1, x2, y2 = (e["x1"] - origin["x"], e["y1"] - origin["y"], e["x2"] - origin["x"],
                              e["y2"] - origin["y"])
            cross, length = x1 * y2 - x2 * y1, _edge_length(e)
            return plus(acc, (cross, (x1 + x2) * cross, (y1 + y2) * cross, length, length * (x1 + x2),
                              length * (y1 + y2)))

        def ring_moments(r, i):
            # shells count and holes are taken off, whatever way they turn
            role = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
            return let(F.aggregate(_ring_edges(r), zero, add_edge), lambda m: F.struct(
                *[m[n].alias(n) for n in names], F.when(m["a"] < 0, -role).otherwise(role).alias("turn")))

        by_ring = F.flatten(F.transform(geom["parts"], lambda part: F.transform(part, ring_moments)))
        total = F.aggregate(by_ring, zero, lambda acc, m: plus(acc, (
            m["turn"] * m["a"], m["turn"] * m["ax"], m["turn"] * m["ay"], m["l"], m["lx"], m["ly"])))
        return let(total, lambda m: position(m, origin))

    def position(m, origin):
        mean = let(vertices(geom), lambda v: _pt(_sum(v["x"], lambda x: x) / F.size(v),
                                                 _sum(v["y"], lambda y: y) / F.size(v)))
        by_area = _pt(origin["x"] + m["ax"] / (3 * m["a"]), origin["y"] + m["ay"] / (3 * m["a"]))
        by_edge = _pt(origin["x"] + m["lx"] / (2 * m["l"]), origin["y"] + m["ly"] / (2 * m["l"]))
        return F.when(geom["type"].endswith("POLYGON") & (m["a"] > 0), by_area).when(
            ~geom["type"].endswith("POINT") & (m["l"] > 0), by_edge).otherwise(mean)

    return F.when(F.size(vertices(geom)) > 0, let(vertices(geom)[0], moments))


def point_on_surface(geom: Column) -> Column:
    """A point that lies on the geometry.

    Polygons: middle of the widest inner span of a scan line half way up, moved off every vertex.
    Lines: middle of the middle edge. Points: the first point.
    """

    def across(s, scan):
        return ((s["y1"] <= scan) & (s["y2"] > scan)) | ((s["y2"] <= scan) & (s["y1"] > scan))

    def widest(hits, scan):
        starts = F.filter(hits, lambda _, i: i % 2 == 0)
        stops = F.filter(hits, lambda _, i: i % 2 == 1)
        spans = F.zip_with(starts, stops, lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2).alias("x")))
        return F.when(F.size(hits) >= 2, _pt(F.array_max(spans)["x"], scan))

    def on_scan(e, scan):
        hits = F.array_sort(F.transform(F.filter(e, lambda s: across(s, scan)), lambda s: s["x1"] + (
            scan - s["y1"]) * (s["x2"] - s["x1"]) / (s["y2"] - s["y1"])))
        return let(hits, lambda h: widest(h, scan))

    def scan_height(ys):
        def between(mid):
            below = F.array_max(F.filter(ys, lambda y: y <= mid))
            above = F.array_min(F.filter(ys, lambda y: y > mid))
            return F.coalesce((below + above) / 2, mid)

        return let((F.array_min(ys) + F.array_max(ys)) / 2, between)

    inside = let(edges(geom), lambda e: let(let(vertices(geom)["y"], scan_height), lambda scan: on_scan(e, scan)))
    middle = let(edges(geom), lambda e: F.get(e, F.floor(F.size(e) / 2).cast("int")))
    on_line = let(middle, lambda m: _pt((m["x1"] + m["x2"]) / 2, (m["y1"] + m["y2"]) / 2))
    first = F.get(vertices(geom), F.lit(0))
    return F.coalesce(F.when(geom["type"].endswith("POLYGON"), inside).when(
        geom["type"].endswith("LINESTRING"), on_line), first)


def distance(a: str, b: str) -> Column:
    """Planar distance of two geometry columns, 0 when they meet."""
    return F.expr(distance_sql(a, b))


def distance_sql(a: str, b: str) -> str:
    from geosieve.functions.predicates import point_edge_gap_sq

    def ends_to(mine, theirs):
        gap = [point_edge_gap_sq(f"p.x{i}", f"p.y{i}", "q") for i in (1, 2)]
        return f"array_min(transform({mine}, p -> array_min(transform({theirs}, q -> least({gap[0]}, {gap[1]})))))"

    pair = f"array(named_struct('a', {edges_sql(a)}, 'b', {edges_sql(b)}))"
    gap = f"transform({pair}, s -> sqrt(least({ends_to('s.a', 's.b')}, {ends_to('s.b', 's.a')})))[0]"
    general = f"if({shapes_meet_sql(a, b)}, 0D, {gap})"
    corner = lambda g, i: f"{g}.parts[0][0][{i}]"
    apart = [f"greatest({corner(b, 0)}.{c} - {corner(a, 2)}.{c}, {corner(a, 0)}.{c} - {corner(b, 2)}.{c}, 0D)" for c in "xy"]
    return (f"if({upright_sql(a)} AND {upright_sql(b)}, sqrt({apart[0]} * {apart[0]} + {apart[1]} * {apart[1]}), {general})")


def upright_sql(g: str) -> str:
    """The geometry is one upright rectangle, its ring from the lower left corner by the lower right one."""
    p = lambda i, c: f"{g}.parts[0][0][{i}].{c}"
    tests = [f"{g}.type = 'POLYGON'", f"size({g}.parts) = 1", f"size({g}.parts[0]) = 1", f"size({g}.parts[0][0]) = 5"]
    tests += [f"{p(0, 'x')} = {p(3, 'x')}", f"{p(0, 'x')} = {p(4, 'x')}", f"{p(1, 'x')} = {p(2, 'x')}",
              f"{p(0, 'y')} = {p(1, 'y')}", f"{p(0, 'y')} = {p(4, 'y')}", f"{p(2, 'y')} = {p(3, 'y')}",
              f"{p(0, 'x')} <= {p(1, 'x')}", f"{p(0, 'y')} <= {p(2, 'y')}"]
    return f"coalesce({' AND '.join(tests)}, false)"


def shapes_meet(a: str, b: str) -> Column:
    """Two geometry columns share a point: edges meet, or one lies inside the other."""
    return F.expr(shapes_meet_sql(a, b))


def shapes_meet_sql(a: str, b: str, a_edges: str = "", b_edges: str = "") -> str:
    """``shapes_meet`` as expression text; edges that are at hand need not be worked out for each pair."""
    from geosieve.functions.predicates import odd_crossings

    def ring_inside(inner, outer, outer_edges):
        # without an edge contact a ring lies wholly inside or outside; one vertex of it decides
        return (f"({outer}.type LIKE '%POLYGON' AND exists(filter(flatten({inner}.parts), r -> size(r) > 0), "
                f"r -> {odd_crossings('r[0].x', 'r[0].y', outer_edges)}))")

    pair = f"array(named_struct('a', {a_edges or edges_sql(a)}, 'b', {b_edges or edges_sql(b)}))"
    touch = f"exists(s.a, p -> exists(s.b, q -> {_segments_meet('p', 'q')}))"
    return f"exists({pair}, s -> {touch} OR {ring_inside(a, b, 's.b')} OR {ring_inside(b, a, 's.a')})"


def _segments_meet(p: str, q: str) -> str:
    def side(e, x, y):
        return f"signum(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({e}.y2 - {e}.y1) * ({x} - {e}.x1))"

    boxes = " AND ".join(
        f"least({m}.{c}1, {m}.{c}2) <= greatest({o}.{c}1, {o}.{c}2)" for c in "xy" for m, o in ((p, q), (q, p)))
    apart = [f"{side(m, f'{o}.x1', f'{o}.y1')} * {side(m, f'{o}.x2', f'{o}.y2')} <= 0" for m, o in ((p, q), (q, p))]
    return f"({boxes} AND {apart[0]} AND {apart[1]})"


# --- constructors ----------------------------------------------------------------------------------


def buffer_point(x: Column, y: Column, radius: Column | float, segments: int = 5) -> Column:
    """Round buffer polygon of a point with ``segments`` edges per quarter circle."""
    if segments < 1:
        raise ValueError("segments must be at least 1")
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    n = 4 * segments
    # angles start over at 0 for the last vertex, so that the ring is closed exactly
    around = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: _pt(
        x + r * F.cos((i % n) * F.lit(2 * math.pi / n)), y + r * F.sin((i % n) * F.lit(2 * math.pi / n))))
    return F.when(r > 0, make_shape("POLYGON", F.array(F.array(around))))


# --- WKT -------------------------------------------------------------------------------------------


def wkt_decimals(crs: str | None) -> int:
    code = (crs or "").rpartition(":")[2]
    geographic = code.isdigit() and 4000 < int(code) < 5000
    return WKT_DECIMALS_GEOGRAPHIC if geographic else WKT_DECIMALS_PROJECTED


def _number(c: Column, decimals: int) -> Column:
    return F.regexp_replace(F.format_string(f"%.{decimals}f", c), r"\.?0+$", "")


def to_wkt(geom: Column, decimals: int = WKT_DECIMALS_PROJECTED) -> Column:
    def vertex(p):
        return F.concat(_number(p["x"], decimals), F.lit(" "), _number(p["y"], decimals))

    def wrap(items):
        return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))

    flat = wrap(F.transform(vertices(geom), vertex))
    one_level = wrap(F.transform(rings(geom), lambda r: wrap(F.transform(r, vertex))))
    two_level = wrap(F.transform(geom["parts"], lambda part: wrap(
        F.transform(part, lambda r: wrap(F.transform(r, vertex))))))
    body = F.when(geom["type"].isin("POINT", "LINESTRING", "MULTIPOINT"), flat).when(
        geom["type"].isin("POLYGON", "MULTILINESTRING"), one_level).otherwise(two_level)
    return F.when(F.size(vertices(geom)) > 0, F.concat(geom["type"], F.lit(" "), body)).when(
        geom.isNotNull(), F.concat(geom["type"], F.lit(" EMPTY")))


def from_wkt(text: Column) -> Column:
    """Geometry struct of a WKT text, NULL where the text is not readable; Z and M are dropped."""
    head = r"^\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(ZM|Z|M)?\s*"
    parts_type = "array<array<array<struct<x: double, y: double>>>>"

    def strip(t):
        return F.regexp_replace(t, r"^\(+|\)+$", "")

    def read_vertex(v):
        return let(F.split(F.trim(v), r"\s+"), lambda xy: F.when(F.size(xy).between(2, 4), _pt(
            F.get(xy, F.lit(0)).try_cast("double"), F.get(xy, F.lit(1)).try_cast("double"))))

    def read_ring(t):
        return F.transform(F.split(strip(t), ","), read_vertex)

    def read_rings(t):
        return F.transform(F.split(strip(t), r"\),\("), read_ring)

    def nesting(kind, body):
        # brackets alone: a ring becomes r, a list of rings p; what is left must suit the type
        bare = F.regexp_replace(body, r"[^(),]+", "")
        one = F.regexp_replace(F.regexp_replace(bare, r"\(,*\)", "r"), ",r", "")
        two = F.regexp_replace(F.regexp_replace(one, r"\(r\)", "p"), ",p", "")
        return F.when(kind.isin("POINT", "LINESTRING", "MULTIPOINT"), one == "r").when(
            kind.isin("POLYGON", "MULTILINESTRING"), two == "p").otherwise(two == "(p)")

    def read_body(t):
        kind, body = t["kind"], t["body"]
        parts = (
            F.when(body == "EMPTY", F.array().cast(parts_type))
            .when(~nesting(kind, body), F.lit(None).cast(parts_type))
            .when(kind.isin("POINT", "LINESTRING"), F.array(F.array(read_ring(body))))
            .when(kind == "MULTIPOINT", F.transform(read_ring(body), lambda p: F.array(F.array(p))))
            .when(kind == "POLYGON", F.array(read_rings(body)))
            .when(kind == "MULTILINESTRING", F.transform(read_rings(body), lambda r: F.array(r)))
            .otherwise(F.transform(F.split(strip(body), r"\)\),\(\("), read_rings))
        )
        return let(parts, lambda p: check(kind, p))

    def check(kind, parts):
        flat = F.flatten(F.flatten(parts))
        readable = F.forall(flat, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        lone = (kind != "POINT") | (F.size(flat) <= 1)
        return F.when((kind != "") & readable & lone, F.struct(kind.alias("type"), parts.alias("parts")).cast(SHAPE_DDL))

    def take_apart(upper):
        kind = F.concat(F.regexp_extract(upper, head, 1), F.regexp_extract(upper, head, 2))
        body = F.regexp_replace(F.regexp_replace(upper, head, ""), r"\s*([(),])\s*", "$1")
        # points of a multi-point may have brackets of their own
        bare = F.regexp_replace(F.regexp_replace(body, r"\),\(", ","), r"^\(\((.*)\)\)$", "($1)")
        return F.struct(kind.alias("kind"), F.when(kind == "MULTIPOINT", bare).otherwise(body).alias("body"))

    return let(F.upper(F.trim(text)), lambda upper: let(take_apart(upper), read_body))


# --- validity --------------------------------------------------------------------------------------


def geometry_issue(geom: Column) -> Column:
    """NULL for a usable geometry, else the first thing wrong with it."""
    polygon, line = geom["type"].endswith("POLYGON"), geom["type"].endswith("LINESTRING")
    all_rings = F.flatten(geom["parts"])
    bad_number = F.exists(vertices(geom), lambda p: ~(finite(p["x"]) & finite(p["y"])))
    short_ring = polygon & F.exists(all_rings, lambda r: F.size(r) < 4)
    short_line = line & F.exists(all_rings, lambda r: F.size(r) < 2)
    open_ring = polygon & F.exists(all_rings, lambda r: (r[0]["x"] != F.element_at(r, -1)["x"]) | (
        r[0]["y"] != F.element_at(r, -1)["y"]))
    return (
        F.when(geom.isNull(), F.lit("null"))
        .when(F.coalesce(F.size(vertices(geom)), F.lit(0)) <= 0, F.lit("empty"))
        .when(bad_number, F.lit("not finite"))
        .when(short_ring | short_line, F.lit("too few vertices"))
        .when(open_ring, F.lit("ring not closed"))
    )


def is_valid(geom: Column) -> Column:
    return geometry_issue(geom).isNull()
