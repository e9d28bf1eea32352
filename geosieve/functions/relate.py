"""Arrow kernels for what Column expressions cannot say: the full relation of two shapes, hull, simplify.

They see candidate pairs or single geometries in Arrow batches; Spark does the pairing and grouping.
The relation is the nine-letter intersection matrix (interior, boundary, exterior of the target against
those of the source) followed by the two dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosieve.functions import geometry as geo
from geosieve.layer import SHAPE_DDL

IN, ON, OUT = 1, 0, -1
TOLERANCE = 1e-9
ALL_PAIRS = 1 << 14  # so many pairs of edges are tested without looking at their heights
BLOCK_PAIRS = 1 << 20  # of edges tested at once
MANY_PAIRS = 1 << 10  # pairs of polygons with at most so many pairs of edges are related many at once
MANY_BLOCK = 1 << 16  # so many pairs of edges, about, to a block


# --- relation --------------------------------------------------------------------------------------


def relation(a: Column, b: Column) -> Column:
    """Intersection matrix of two geometry structs, NULL when one is NULL or empty."""
    return flat_relation(a["type"], flat_edges(a), b["type"], flat_edges(b))


def flat_edges(g: Column) -> Column:
    """Edges of a geometry as one list x1, y1, x2, y2, x1, ...; worked out before a join, it serves all pairs of a row."""
    return F.flatten(F.transform(geo.edges(g), lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))


def flat_relation(kind_a: Column, a: Column, kind_b: Column, b: Column) -> Column:
    """``relation`` of two geometries given by their types and ``flat_edges``."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _relation_udf(kind_a, a, kind_b, b))


def _matches(matrix: Column, at: int, value: str) -> Column:
    cell = F.substring(matrix, at + 1, 1)
    return cell == "F" if value == "F" else cell != "F"


def relation_holds(name: str, matrix: Column) -> Column:
    ii, ib, ie, bi, bb, be, ei, eb = (lambda v, i=i: _matches(matrix, i, v) for i in range(8))
    meet = ii("T") | ib("T") | bi("T") | bb("T")
    dim_a, dim_b = F.substring(matrix, 10, 1), F.substring(matrix, 11, 1)
    table = {
        "intersects": meet,
        "disjoint": ~meet,
        "contains": ii("T") & ei("F") & eb("F"),
        "within": ii("T") & ie("F") & be("F"),
        "covers": meet & ei("F") & eb("F"),
        "coveredby": meet & ie("F") & be("F"),
        "equals": ii("T") & ie("F") & be("F") & ei("F") & eb("F"),
        "touches": ii("F") & meet,
        "overlaps": (dim_a == dim_b) & ie("T") & ei("T") & F.when(
            dim_a == "1", F.substring(matrix, 1, 1) == "1").otherwise(ii("T")),
        "crosses": F.when(dim_a < dim_b, ii("T") & ie("T")).when(dim_a > dim_b, ii("T") & ei("T")).otherwise(
            (dim_a == "1") & (F.substring(matrix, 1, 1) == "0")),
    }
    return table[name]


def _dimension(kind: str) -> int:
    return 2 if kind.endswith("POLYGON") else 1 if kind.endswith("LINESTRING") else 0


def _ends(edges: np.ndarray) -> np.ndarray:
    """Boundary points of line work: vertices that an odd number of edges end in."""
    points, counts = np.unique(edges.reshape(-1, 2), axis=0, return_counts=True)
    return points[counts % 2 == 1]


def _heights(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])


def _strips(low: np.ndarray, high: np.ndarray, base: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(strip, which) for every strip of heights that a span of heights lies in, sorted by strip."""
    first = np.floor((low - base) / width).astype(np.int64)
    n = np.floor((high - base) / width).astype(np.int64) - first + 1
    which = np.repeat(np.arange(len(low)), n)
    strip = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
    order = np.argsort(strip, kind="stable")
    return strip[order], which[order]


def _level_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j), among them once each all whose heights (low, high) come within eps of each other.

    Few pairs are one block. Otherwise the plane is cut into level strips that hold a few edges each, so that time and
    memory follow the pairs that are level with each other, and a block never has more than some million pairs.
    """
    n_a, n_b = len(a[0]), len(b[0])
    if n_a * n_b <= ALL_PAIRS:
        if n_a * n_b:
            yield np.repeat(np.arange(n_a), n_b), np.tile(np.arange(n_b), n_a)
        return
    a, b = (a[0] - eps, a[1] + eps), (b[0] - eps, b[1] + eps)
    base, top = max(a[0].min(), b[0].min()), min(a[1].max(), b[1].max())
    if top < base:
        return
    a, b = ((np.clip(low, base, top), np.clip(high, base, top), np.flatnonzero((low <= top) & (high >= base)))
            for low, high in (a, b))
    a, b = ((low[own], high[own], own) for low, high, own in (a, b))
    # strips are as low as can be without listing an edge eight times on average
    listed, least = len(a[0]) + len(b[0]), (top - base) / max(n_a, n_b, 1) or 1.0
    reach = float((a[1] - a[0]).sum() + (b[1] - b[0]).sum())
    width = max(least, reach / (7 * listed))
    (s_a, i_a), (s_b, i_b) = (_strips(low, high, base, width) for low, high, _ in (a, b))
    first_a, first_b = (np.floor((x[0] - base) / width).astype(np.int64) for x in (a, b))
    ends = np.searchsorted(s_b, s_a, "left"), np.searchsorted(s_b, s_a, "right")
    count = ends[1] - ends[0]
    total = np.cumsum(count)
    begin = 0
    while begin < len(count):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + BLOCK_PAIRS, "right")))
        n = count[begin:end]
        left = np.repeat(i_a[begin:end], n)
        right = i_b[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[0][begin:end], n)]
        # a pair meets in the first strip that both lie in
        own = np.repeat(s_a[begin:end], n) == np.maximum(first_a[left], first_b[right])
        yield a[2][left[own]], b[2][right[own]]
        begin = end


def _on_edge(points: np.ndarray, edges: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Which points lie on their edges (within eps), and where along them; row by row."""
    start, step = edges[:, :2], edges[:, 2:] - edges[:, :2]
    length_sq = np.maximum((step**2).sum(1), 1e-300)
    off = points - start
    t = np.clip((off * step).sum(1) / length_sq, 0, 1)
    gap = off - t[:, None] * step
    return (gap**2).sum(1) <= eps * eps, t


def _locate(points: np.ndarray, dim: int, edges: np.ndarray, eps: float) -> np.ndarray:
    n = len(points)
    on, crossings = np.zeros(n, bool), np.zeros(n, np.int64)
    for i, j in _level_pairs((points[:, 1], points[:, 1]), _heights(edges), eps):
        p, e = points[i], edges[j]
        on[i[_on_edge(p, e, eps)[0]]] = True
        if dim == 2:
            x1, y1, x2, y2 = e.T
            spans = (y1 <= p[:, 1]) != (y2 <= p[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                right = x1 + (p[:, 1] - y1) * (x2 - x1) / (y2 - y1) > p[:, 0]
            crossings += np.bincount(i[spans & right], minlength=n)
    if dim == 2:
        return np.where(on, ON, np.where(crossings % 2 == 1, IN, OUT))
    if dim == 0:
        return np.where(on, IN, OUT)
    ends = _ends(edges)
    at_end = np.zeros(n, bool)
    for i, j in _level_pairs((points[:, 1], points[:, 1]), (ends[:, 1], ends[:, 1]), eps):
        at_end[i[np.abs(points[i] - ends[j]).max(1) <= eps]] = True
    return np.where(at_end, ON, np.where(on, IN, OUT))


def _cuts(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(edge of a, position on it) of every contact with the edges of b."""
    edge_no, position = [np.empty(0, np.int64)], [np.empty(0)]
    for i, j in _level_pairs(_heights(a), _heights(b), eps):
        one, two = a[i], b[j]
        d, e, gap = one[:, 2:] - one[:, :2], two[:, 2:] - two[:, :2], two[:, :2] - one[:, :2]
        denominator = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / denominator
            u = (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / denominator
            hit = (denominator != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        edge_no.append(i[hit]), position.append(t[hit])
        for end in (two[:, :2], two[:, 2:]):
            on, where = _on_edge(end, one, eps)
            edge_no.append(i[on]), position.append(where[on])
    return np.concatenate(edge_no), np.concatenate(position)


def _pieces(edges: np.ndarray, edge_no: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and direction of the pieces that the cuts leave."""
    return _pieces_of(edges, edge_no, position)[:2]


def _pieces_of(edges: np.ndarray, edge_no: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle, direction and edge of the pieces that the cuts leave, by edge."""
    n = len(edges)
    edge_no = np.concatenate([np.arange(n), np.arange(n), edge_no])
    position = np.concatenate([np.zeros(n), np.ones(n), position])
    order = np.lexsort((position, edge_no))
    edge_no, position = edge_no[order], position[order]
    keep = (edge_no[1:] == edge_no[:-1]) & (position[1:] - position[:-1] > TOLERANCE)
    middle, i = ((position[1:] + position[:-1]) / 2)[keep], edge_no[1:][keep]
    step = edges[i, 2:] - edges[i, :2]
    return edges[i, :2] + middle[:, None] * step, step, i


def _relate(dim_a: int, a: np.ndarray, dim_b: int, b: np.ndarray) -> str:
    eps = max(np.abs(a).max(), np.abs(b).max(), 1.0) * TOLERANCE
    m = {k: "F" for k in ("II", "IB", "IE", "BI", "BB", "BE", "EI", "EB")}

    def put(key: str, dim: int, when) -> None:
        if when and (m[key] == "F" or int(m[key]) < dim):
            m[key] = str(dim)

    a_cuts, b_cuts = _cuts(a, b, eps), _cuts(b, a, eps)
    contacts = a[a_cuts[0], :2] + a_cuts[1][:, None] * (a[a_cuts[0], 2:] - a[a_cuts[0], :2])

    for dim, own, cuts, other_dim, other, flip in (
        (dim_a, a, a_cuts, dim_b, b, False), (dim_b, b, b_cuts, dim_a, a, True)):
        key = (lambda mine, theirs: theirs + mine) if flip else (lambda mine, theirs: mine + theirs)
        if dim == 0:
            where = _locate(own[:, :2], other_dim, other, eps)
            for code, theirs in ((IN, "I"), (ON, "B"), (OUT, "E")):
                put(key("I", theirs), 0, (where == code).any())
            continue
        middles, steps = _pieces(own, *cuts)
        where = _locate(middles, other_dim, other, eps)
        has_in, has_on, has_out = ((where == c).any() for c in (IN, ON, OUT))
        if dim == 1:
            put(key("I", "I"), 1, has_in)
            put(key("I", "B"), 1, has_on)
            put(key("I", "E"), 1, has_out)
            at_ends = _locate(_ends(own), other_dim, other, eps)
            for code, theirs in ((IN, "I"), (ON, "B"), (OUT, "E")):
                put(key("B", theirs), 0, (at_ends == code).any())
        elif other_dim == 2:
            put(key("B", "I"), 1, has_in)
            put(key("B", "B"), 1, has_on)
            put(key("B", "E"), 1, has_out)
            put(key("I", "I"), 2, has_in)
            put(key("E", "I"), 2, has_in)
            put(key("I", "E"), 2, has_out)
            # shared border: look at both sides of it
            normal = np.stack([-steps[:, 1], steps[:, 0]], 1)[where == ON]
            size = np.maximum(np.hypot(normal[:, :1], normal[:, 1:]), 1e-300)
            for side in (1, -1):
                probe = middles[where == ON] + side * normal / size * eps * 1000
                mine, theirs = _locate(probe, 2, own, eps) == IN, _locate(probe, 2, other, eps) == IN
                put(key("I", "I"), 2, (mine & theirs).any())
                put(key("I", "E"), 2, (mine & ~theirs).any())
                put(key("E", "I"), 2, (~mine & theirs).any())
        else:
            # a polygon reaches beyond any line or point; so does its border, unless lines cover it
            put(key("I", "E"), 2, True)
            covered = _locate(middles, other_dim, other, eps) != OUT
            put(key("B", "E"), 1, (~covered).any())
    if len(contacts):
        at_a, at_b = _locate(contacts, dim_a, a, eps), _locate(contacts, dim_b, b, eps)
        for i, mine in ((IN, "I"), (ON, "B")):
            for j, theirs in ((IN, "I"), (ON, "B")):
                put(mine + theirs, 0, ((at_a == i) & (at_b == j)).any())
    return "".join(m.values()) + "2" + str(dim_a) + str(dim_b)


# --- many small pairs of polygons at once -----------------------------------------------------------


def _cross(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of every item of a with every item of b of the same pair; items lie pair by pair."""
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    n = n_a * n_b
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(n_b, n)
    return np.repeat(start_a, n) + at // wide, np.repeat(start_b, n) + at % wide


def _counts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n)


def _locate_many(points: np.ndarray, owner: np.ndarray, edges: np.ndarray, n_edges: np.ndarray, eps: np.ndarray) -> np.ndarray:
    """``_locate`` in polygons, for points of many pairs sorted by their pair (``owner``)."""
    i, j = _cross(_counts(owner, len(n_edges)), n_edges)
    # only edges level with a point can hold it or be crossed by its ray
    y, margin = points[i, 1], 2 * eps[owner][i]
    low, high = _heights(edges)
    level = (low[j] <= y + margin) & (high[j] >= y - margin)
    i, j = i[level], j[level]
    p, e = points[i], edges[j]
    on = np.zeros(len(points), bool)
    margin = margin[level]
    near = (np.minimum(e[:, 0], e[:, 2]) <= p[:, 0] + margin) & (np.maximum(e[:, 0], e[:, 2]) >= p[:, 0] - margin)
    at = i[near]
    on[at[_on_edge(p[near], e[near], eps[owner[at]])[0]]] = True
    x1, y1, x2, y2 = e.T
    spans = (y1 <= p[:, 1]) != (y2 <= p[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x1 + (p[:, 1] - y1) * (x2 - x1) / (y2 - y1) > p[:, 0]
    crossings = np.bincount(i[spans & right], minlength=len(points))
    return np.where(on, ON, np.where(crossings % 2 == 1, IN, OUT))


def _cuts_many(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, eps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = a[i], b[j]
    d, e, gap = one[:, 2:] - one[:, :2], two[:, 2:] - two[:, :2], two[:, :2] - one[:, :2]
    denominator = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / denominator
        u = (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / denominator
        hit = (denominator != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    edge_no, position = [i[hit]], [t[hit]]
    for end in (two[:, :2], two[:, 2:]):
        on, where = _on_edge(end, one, eps)
        edge_no.append(i[on]), position.append(where[on])
    return np.concatenate(edge_no), np.concatenate(position)


def _relate_polygons(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[str]:
    """``_relate`` for many pairs of polygons: the edges of all a, those of all b, and how many each pair has."""
    n = len(n_a)
    owner_a, owner_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    largest = [np.maximum.reduceat(np.abs(e).max(1), np.cumsum(k) - k) for e, k in ((a, n_a), (b, n_b))]
    eps = np.maximum(np.maximum(*largest), 1.0) * TOLERANCE
    m = {k: np.full(n, -1) for k in ("II", "IB", "IE", "BI", "BB", "BE", "EI", "EB")}

    def put(key: str, dim: int, owner: np.ndarray, when: np.ndarray) -> None:
        found = owner[when]
        m[key][found] = np.maximum(m[key][found], dim)

    i, j = _cross(n_a, n_b)
    margin, near = 2 * eps[owner_a][i], np.ones(len(i), bool)
    for at in (0, 1):
        (low_a, high_a), (low_b, high_b) = ((np.minimum(e[:, at], e[:, at + 2]), np.maximum(e[:, at], e[:, at + 2]))
                                            for e in (a, b))
        near &= (low_a[i] <= high_b[j] + margin) & (low_b[j] <= high_a[i] + margin)
    i, j = i[near], j[near]
    a_cuts = _cuts_many(a, b, i, j, eps[owner_a[i]])
    b_cuts = _cuts_many(b, a, j, i, eps[owner_a[i]])
    for own, owner, n_own, cuts, other, n_other, flip in (
            (a, owner_a, n_a, a_cuts, b, n_b, False), (b, owner_b, n_b, b_cuts, a, n_a, True)):
        key = (lambda mine, theirs: theirs + mine) if flip else (lambda mine, theirs: mine + theirs)
        middles, steps, edge = _pieces_of(own, *cuts)
        pair = owner[edge]
        where = _locate_many(middles, pair, other, n_other, eps)
        for code, theirs in ((IN, "I"), (ON, "B"), (OUT, "E")):
            put(key("B", theirs), 1, pair, where == code)
        put(key("I", "I"), 2, pair, where == IN)
        put(key("E", "I"), 2, pair, where == IN)
        put(key("I", "E"), 2, pair, where == OUT)
        # shared border: look at both sides of it
        shared = where == ON
        pair, normal = pair[shared], np.stack([-steps[:, 1], steps[:, 0]], 1)[shared]
        size = np.maximum(np.hypot(normal[:, :1], normal[:, 1:]), 1e-300)
        for side in (1, -1):
            probe = middles[shared] + side * normal / size * eps[pair][:, None] * 1000
            mine = _locate_many(probe, pair, own, n_own, eps) == IN
            theirs = _locate_many(probe, pair, other, n_other, eps) == IN
            put(key("I", "I"), 2, pair, mine & theirs)
            put(key("I", "E"), 2, pair, mine & ~theirs)
            put(key("E", "I"), 2, pair, ~mine & theirs)
    order = np.argsort(a_cuts[0], kind="stable")
    edge, position = a_cuts[0][order], a_cuts[1][order]
    contacts, pair = a[edge, :2] + position[:, None] * (a[edge, 2:] - a[edge, :2]), owner_a[edge]
    at_a, at_b = _locate_many(contacts, pair, a, n_a, eps), _locate_many(contacts, pair, b, n_b, eps)
    for code, mine in ((IN, "I"), (ON, "B")):
        for other_code, theirs in ((IN, "I"), (ON, "B")):
            put(mine + theirs, 0, pair, (at_a == code) & (at_b == other_code))
    letters = np.array(["0", "1", "2", "F"])
    text = letters[m["II"]]
    for k in list(m)[1:]:
        text = np.char.add(text, letters[m[k]])
    return np.char.add(text, "222").tolist()


def _taken(edges: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The edges of some rows of a batch, in a row."""
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    return edges[at]


@F.arrow_udf(T.StringType())
def _relation_udf(kind_a: pa.Array, edges_a: pa.Array, kind_b: pa.Array, edges_b: pa.Array) -> pa.Array:
    sides = []
    for kind, lists in ((kind_a, edges_a), (kind_b, edges_b)):
        offsets = lists.offsets.to_numpy().astype(np.int64)
        own = pc.fill_null(pc.ends_with(kind, "POLYGON"), False).to_numpy(zero_copy_only=False)
        values = lists.values.to_numpy(zero_copy_only=False).reshape(-1, 4)
        n = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets) // 4, 0)
        sides.append((own, values, offsets[:-1] // 4, n))
    (own_a, a, at_a, n_a), (own_b, b, at_b, n_b) = sides
    out: list[str | None] = [None] * len(n_a)
    known = (n_a > 0) & (n_b > 0)
    pairs = n_a * n_b
    small = np.flatnonzero(known & own_a & own_b & (pairs <= MANY_PAIRS))
    # blocks of some edge pairs; probing points are a few times the edges
    block = np.cumsum(pairs[small]) // MANY_BLOCK
    for rows in np.split(small, np.flatnonzero(np.diff(block)) + 1) if len(small) else ():
        found = _relate_polygons(_taken(a, at_a[rows], n_a[rows]), n_a[rows], _taken(b, at_b[rows], n_b[rows]), n_b[rows])
        for row, text in zip(rows.tolist(), found):
            out[row] = text
    rest = known.copy()
    rest[small] = False
    for row in np.flatnonzero(rest).tolist():
        out[row] = _relate(_dimension(kind_a[row].as_py()), a[at_a[row]:at_a[row] + n_a[row]],
                           _dimension(kind_b[row].as_py()), b[at_b[row]:at_b[row] + n_b[row]])
    return pa.array(out, pa.string())


# --- hull ------------------------------------------------------------------------------------------


def _hull_points(points: np.ndarray) -> np.ndarray:
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(sequence):
        kept: list = []
        for p in sequence:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (
                    kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(chain(points) + chain(points[::-1]))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hull_udf(xs: pa.Array, ys: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(xs, ys):
        if not x.is_valid or len(x) == 0:
            out.append(None)
            continue
        out.append(_hull_points(np.column_stack([x.values.to_numpy(), y.values.to_numpy()])).ravel())
    return pa.array(out, pa.list_(pa.float64()))


def hull_coordinates(geom: Column) -> Column:
    """Corners of the convex hull of one geometry as a flat list x, y, x, y, ..."""
    v = geo.vertices(geom)
    return _hull_udf(v["x"], v["y"])


def hull_shape(flat: Column) -> Column:
    """The hull as a geometry: a polygon, or a line or point where it has no area."""
    n = (F.size(flat) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(flat, i * 2).alias("x"), F.get(flat, i * 2 + 1).alias("y")))
    closed = F.when(n > 2, F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    kind = F.when(n > 2, F.lit("POLYGON")).when(n == 2, F.lit("LINESTRING")).otherwise(F.lit("POINT"))
    return F.when(n > 0, F.struct(kind.alias("type"), F.array(F.array(closed)).alias("parts")).cast(SHAPE_DDL))


# --- simplify --------------------------------------------------------------------------------------


def _simplify_mask(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: which vertices of one ring or line stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        first, last = stack.pop()
        if last - first < 2:
            continue
        inner, base = points[first + 1 : last] - points[first], points[last] - points[first]
        length = np.hypot(*base)
        if length == 0:
            gap = np.hypot(inner[:, 0], inner[:, 1])
        else:
            gap = np.abs(inner[:, 0] * base[1] - inner[:, 1] * base[0]) / length
        far = int(gap.argmax())
        if gap[far] > tolerance:
            middle = first + 1 + far
            keep[middle] = True
            stack += [(first, middle), (middle, last)]
    return keep


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _kept_udf(xs: pa.Array, ys: pa.Array, tolerance: pa.Array) -> pa.Array:
    out = []
    for x_rings, y_rings, tol in zip(xs, ys, tolerance):
        if not x_rings.is_valid or not tol.is_valid:
            out.append(None)
            continue
        out.append([np.flatnonzero(_simplify_mask(
            np.column_stack([x.values.to_numpy(), y.values.to_numpy()]), tol.as_py())).tolist()
            for x, y in zip(x_rings.values, y_rings.values)])
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def kept_vertices(geom: Column, tolerance: Column) -> Column:
    """Per ring or line: positions of the vertices that stay."""
    flat = geo.rings(geom)
    return _kept_udf(F.transform(flat, lambda r: r["x"]), F.transform(flat, lambda r: r["y"]), tolerance)


def thinned(geom: Column, kept: Column) -> Column:
    """The geometry with the kept vertices; a ring or line that would collapse stays as it is."""
    least = F.when(geom["type"].endswith("POLYGON"), F.lit(4)).otherwise(F.lit(2))
    thin = F.zip_with(geo.rings(geom), kept, lambda r, k: F.when(
        F.size(k) >= least, F.transform(k, lambda i: F.get(r, i))).otherwise(r))

    def regroup(rings):
        # parts keep their number of rings: cut the flat list up again
        sizes = F.transform(geom["parts"], lambda p: F.size(F.filter(p, lambda r: F.size(r) > 0)))
        starts = lambda n, i: F.aggregate(F.slice(sizes, 1, i), F.lit(1), lambda a, b: a + b)
        return F.zip_with(F.transform(sizes, starts), sizes, lambda at, n: F.slice(rings, at, n))

    fine = geom["type"].endswith("POINT") | kept.isNull()
    return F.when(fine, geom).otherwise(F.struct(
        geom["type"].alias("type"), geo.let(thin, regroup).alias("parts")).cast(SHAPE_DDL))
