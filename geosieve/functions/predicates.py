"""Exact spatial predicates as SQL expressions.

``P(target, source)`` everywhere: ``contains`` means the target contains the source. Closed forms cover
point and box pairs and stay inside whole-stage codegen; a point against a line or polygon is
classified over the edge array of the shape (interior, boundary, exterior) with JVM higher-order
functions. Distances are compared squared, so that no root is taken.

The functions take and return expression text for ``F.expr``: one text is parsed once in the JVM, while the
same thing built Column by Column costs hundreds of calls from Python.
"""

from __future__ import annotations

from collections.abc import Iterable

# Predicate names.
PREDICATES = (
    "intersects",
    "contains",
    "within",
    "touches",
    "overlaps",
    "crosses",
    "disjoint",
    "equals",
    "covers",
    "coveredby",
    "dwithin",
)

MIRROR = {"within": "contains", "contains": "within", "covers": "coveredby", "coveredby": "covers"}
NEVER = "false"
Box = tuple[str, str, str, str]


def check_predicates(names) -> tuple[str, ...]:
    names = (names,) if isinstance(names, str) else tuple(names)
    cleaned = tuple(dict.fromkeys(n.lower().removeprefix("st_").replace("_", "") for n in names))
    unknown = [n for n in cleaned if n not in PREDICATES]
    if unknown:
        raise ValueError(f"unknown predicate {', '.join(unknown)}")
    return cleaned


def any_of(conditions: Iterable[str]) -> str:
    found = [c for c in conditions if c != NEVER]
    return "(" + " OR ".join(found) + ")" if found else NEVER


def pick(names, table: dict[str, str]) -> str:
    return any_of(table.get(n, NEVER) for n in names)


def bbox_overlap(t: Box, s: Box) -> str:
    return f"({t[0]} <= {s[2]} AND {t[2]} >= {s[0]} AND {t[1]} <= {s[3]} AND {t[3]} >= {s[1]})"


def bbox_covers(a: Box, b: Box) -> str:
    return f"({a[0]} <= {b[0]} AND {a[2]} >= {b[2]} AND {a[1]} <= {b[1]} AND {a[3]} >= {b[3]})"


# --- distances ---------------------------------------------------------------------------------


def _squares(dx: str, dy: str) -> str:
    return f"({dx} * {dx} + {dy} * {dy})"


def box_gap_sq(t: Box, s: Box) -> str:
    """Squared distance of two boxes (points are boxes without extent)."""
    if t[0] == t[2] and s[0] == s[2]:
        return _squares(f"({t[0]} - {s[0]})", f"({t[1]} - {s[1]})")
    return _squares(f"greatest({s[0]} - {t[2]}, {t[0]} - {s[2]}, 0D)", f"greatest({s[1]} - {t[3]}, {t[1]} - {s[3]}, 0D)")


def box_reach_sq(t: Box, s: Box) -> str:
    """Squared distance of the farthest corner of ``t`` from the box ``s``."""
    return _squares(f"greatest({s[0]} - {t[0]}, {t[2]} - {s[2]}, 0D)", f"greatest({s[1]} - {t[1]}, {t[3]} - {s[3]}, 0D)")


def point_edge_gap_sq(x: str, y: str, e: str) -> str:
    """Squared distance of a point from one edge ``struct<x1, y1, x2, y2>``."""
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    length_sq = _squares(dx, dy)
    along = f"(({x} - {e}.x1) * {dx} + ({y} - {e}.y1) * {dy})"
    t = f"if({length_sq} > 0, least(greatest({along} / {length_sq}, 0D), 1D), 0D)"
    return _squares(f"({x} - {e}.x1 - {t} * {dx})", f"({y} - {e}.y1 - {t} * {dy})")


# --- point against the edges of a shape ----------------------------------------------------------


def _turn(x: str, y: str, e: str) -> str:
    return f"(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({e}.y2 - {e}.y1) * ({x} - {e}.x1))"


def on_any_edge(x: str, y: str, edges: str) -> str:
    return (f"exists({edges}, e -> {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND "
            f"{y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2) AND {_turn(x, y, 'e')} = 0)")


def odd_crossings(x: str, y: str, edges: str) -> str:
    """The ray from the point towards +x crosses an odd number of edges (lower ends count, upper do not)."""
    turn = _turn(x, y, "e")
    return (f"(size(filter({edges}, e -> (e.y1 <= {y} AND e.y2 > {y} AND {turn} > 0) OR "
            f"(e.y2 <= {y} AND e.y1 > {y} AND {turn} < 0))) % 2 = 1)")


def line_end(x: str, y: str, ends: str) -> str:
    """The point is a boundary point of a (multi)line: an end of an odd number of its parts."""
    return f"(size(filter({ends}, p -> p.x = {x} AND p.y = {y})) % 2 = 1)"


def near_any_edge(x: str, y: str, edges: str, reach_sq: str, strict: bool = False) -> str:
    return f"exists({edges}, e -> {point_edge_gap_sq(x, y, 'e')} {'<' if strict else '<='} {reach_sq})"


# --- predicate tables ------------------------------------------------------------------------------


def point_point(names, t: Box, s: Box) -> str:
    same = f"({t[0]} = {s[0]} AND {t[1]} = {s[1]})"
    table = {n: same for n in ("intersects", "contains", "within", "equals", "covers", "coveredby")}
    return pick(names, table | {"disjoint": f"(NOT {same})"})


def _inner(a0: str, a1: str, b0: str, b1: str) -> str:
    """The insides of two intervals meet; an interval of no length is its own inside."""
    return (f"((greatest({a0}, {b0}) < least({a1}, {b1})) OR ({a0} = {a1} AND {b0} < {a0} AND {a0} < {b1}) OR "
            f"({b0} = {b1} AND {a0} < {b0} AND {b0} < {a1}) OR ({a0} = {a1} AND {b0} = {b1} AND {a0} = {b0}))")


def point_box(names, t: Box, s: Box) -> str:
    """A point against a rectangle, which may be flat: a segment's inside is what lies between its ends."""
    inside = " AND ".join(f"(({p} > {lo} AND {p} < {hi}) OR ({lo} = {hi} AND {p} = {lo}))"
                          for p, lo, hi in ((t[0], s[0], s[2]), (t[1], s[1], s[3])))
    inside = f"({inside})"
    covered = f"({t[0]} >= {s[0]} AND {t[0]} <= {s[2]} AND {t[1]} >= {s[1]} AND {t[1]} <= {s[3]})"
    same = f"({t[0]} = {s[0]} AND {t[0]} = {s[2]} AND {t[1]} = {s[1]} AND {t[1]} = {s[3]})"
    return pick(names, {"intersects": covered, "coveredby": covered, "within": inside, "equals": same,
                        "contains": same, "covers": same,
                        "touches": f"({covered} AND NOT {inside})", "disjoint": f"(NOT {covered})"})


def box_point(names, t: Box, s: Box) -> str:
    return point_box([MIRROR.get(n, n) for n in names], s, t)


def box_box(names, t: Box, s: Box) -> str:
    """Closed forms for two rectangles, which may be flat (segments or points)."""
    meet, covers, coveredby = bbox_overlap(t, s), bbox_covers(t, s), bbox_covers(s, t)
    inner = f"({_inner(t[0], t[2], s[0], s[2])} AND {_inner(t[1], t[3], s[1], s[3])})"
    wide = {k: (f"({b[2]} > {b[0]})", f"({b[3]} > {b[1]})") for k, b in (("t", t), ("s", s))}
    (tx, ty), (sx, sy) = wide["t"], wide["s"]
    alike = f"({tx} = {sx} AND {ty} = {sy})"
    line_t, line_s = f"({tx} != {ty})", f"({sx} != {sy})"
    area_t, area_s = f"({tx} AND {ty})", f"({sx} AND {sy})"
    crosses = (f"({inner} AND (({line_t} AND {area_s} AND NOT {coveredby}) OR ({area_t} AND {line_s} AND NOT {covers}) "
               f"OR ({line_t} AND {line_s} AND {tx} != {sx})))")
    return pick(names, {
        "intersects": meet,
        "contains": f"({covers} AND {inner})",
        "covers": covers,
        "within": f"({coveredby} AND {inner})",
        "coveredby": coveredby,
        "equals": f"({covers} AND {coveredby})",
        "touches": f"({meet} AND NOT {inner})",
        "overlaps": f"({alike} AND {inner} AND NOT {covers} AND NOT {coveredby})",
        "crosses": crosses,
        "disjoint": f"(NOT {meet})",
    })


def point_shape(names, x: str, y: str, kind: str, edges: str, ends: str, full: str = NEVER) -> str:
    """A point against a line, polygon or point shape; ``full`` marks a tile lying inside the shape."""
    touch, odd, at_end = on_any_edge(x, y, edges), odd_crossings(x, y, edges), line_end(x, y, ends)
    polygon, line = f"{kind} LIKE '%POLYGON'", f"{kind} LIKE '%LINESTRING'"
    covered = f"({full} OR ({polygon} AND {odd}) OR {touch})"
    inside = (f"({full} OR CASE WHEN {polygon} THEN {odd} AND NOT {touch} WHEN {line} THEN {touch} AND NOT {at_end} "
              f"ELSE {touch} END)")
    border = f"(NOT {full} AND CASE WHEN {polygon} THEN {touch} WHEN {line} THEN {at_end} ELSE false END)"
    same = f"({kind} = 'POINT' AND {touch})"
    return pick(names, {"intersects": covered, "coveredby": covered, "within": inside, "touches": border,
                        "equals": same, "contains": same, "covers": same, "disjoint": f"(NOT {covered})"})
